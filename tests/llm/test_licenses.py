import random
import re

import duckdb

from loomstone.llm import licenses as L


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        wanted = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_base_columns(spark, odd_documents, no_documents):
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    found = [tuple(r[c] for c in COLUMNS) for r in L.op4_licenses(spark, path).collect()]
    assert sorted(found) == sorted((d, *base(t)) for d, t in rows)
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    found = [tuple(r[c] for c in COLUMNS) for r in L.license_scan(odd_documents).collect()]
    assert sorted(map(repr, found)) == sorted(repr((d, *base(t))) for d, t in odd)
    assert L.license_scan(no_documents).count() == 0


def test_templates():
    compiled = L.compile_templates(L.TEMPLATES)
    labels = lambda text: L.scan(text.encode(), compiled)[5]
    assert labels("Released under the MIT License.") == "mit,mit-notice"
    assert labels("Released under the terms of the MIT License") == "mit,mit-notice"
    assert labels("Released under terms of the MIT License") == "mit"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-notice"
    assert labels("MIT-License, Apache License; GNU General Public License") == "apache,gpl,mit"
    assert labels("mitt license cc bys") == ""
    header = "Loom is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert labels("x " * 500 + header + " y" * 500) == "gpl,gpl-header"
    assert labels(header.replace("modify", "change")) == "gpl"


def test_automaton_by_brute_force():
    template = "<<opt>>a<</opt>> b <<var:2>> {c|d} <<opt>>e <<opt>>f<</opt>><</opt>> g"
    automaton = L.Automaton(template)
    pattern = re.compile(r"^(a )?b (\w+ ){0,2}[cd] (e (f )?)?g$")
    import itertools

    for n in range(1, 7):
        for tokens in itertools.product("abcefg", repeat=n):
            hit = automaton.accepts([t.encode() for t in tokens])
            want = any(pattern.match(" ".join(tokens[i:j])) for i in range(n) for j in range(i + 1, n + 1))
            assert bool(hit) == want, tokens


def test_many_false_anchors():
    text = "licensed under " * 3000 + "the Apache License, Version 2.0"
    found = L.scan(text.encode(), L.compile_templates(L.TEMPLATES))
    assert found[5] == "apache,apache-2.0-notice" and found[2] == found[3] == 6001


def resolved(template, rng):
    """Wording that a template stands for: optional parts left out at random, replaceable ones replaced, one of several words taken."""
    while "<<opt>>" in template:
        template = re.sub(r"<<opt>>((?:(?!<<opt>>).)*?)<</opt>>", lambda m: m[1] if rng.random() < 0.5 else " ", template)
    template = re.sub(r"<<var:(\d+)>>", lambda m: " ".join(["Some"] * rng.randint(0, int(m[1]))), template)
    return re.sub(r"\{([^}]*)\}", lambda m: rng.choice(m[1].split("|")), template).split()


def test_every_template_accepts_its_wording_and_no_other():
    rng, compiled = random.Random(11), L.compile_templates(L.TEMPLATES)
    for label, template in L.TEMPLATES.items():
        automaton = L.Automaton(template)
        for _ in range(4):
            wording = resolved(template, rng)
            text = "(c) 2024 Loom, Inc.\n" + ", ".join(w.upper() if rng.random() < 0.2 else w for w in wording) + ".\n\nint main() {}"
            found = L.scan(text.encode(), compiled)
            assert label in found[5].split(",") and found[6] == (1.0 if automaton.mandatory >= L.TEXT_WORDS else max(found[6], 0.75)), label
            anchor = next(i for i in range(len(wording)) if [w.encode() for w in wording[i : i + len(automaton.anchor)]] == automaton.anchor)
            changed = [*wording[: anchor + 1], "notably", *wording[anchor + 1 :]] if len(automaton.anchor) > 1 else None
            assert changed is None or label not in L.scan(" ".join(changed).encode(), compiled)[5].split(",")


def test_scores():
    compiled = L.compile_templates(L.TEMPLATES)
    score = lambda text: L.scan(text.encode(), compiled)[6]
    mit = " ".join(resolved(L.TEMPLATES["mit-text"], random.Random(1)))
    assert score(mit) == 1 and score("released under the MIT license") == 0.75 and score("see the MIT license") == 0.5 and score("weft") == score("") == 0
    mpl = " ".join(resolved(L.TEMPLATES["mpl-2.0-header"], random.Random(1)))
    assert score(mpl) == 1 and score(mpl.replace("mozilla org", "example org")) == 0.25
    long = L.scan((mit + " ").encode() * 2000, compiled)
    assert long[0] == 2000 * len(mit.split()) and long[6] == 1
