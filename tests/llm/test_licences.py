import re

from shoal.llm.licences import BASE, Index, licence_report, scan_licences


def test_base_places(documents):
    texts = ["Under the MIT License, under the mit-license. cc-by_nc", "Apache License, Version 2.0; apache license version 2 under THE mit license", "nothing", "cc by nc by nc cc by nc", "ünder the mit license"]
    rows = {r["doc_id"]: r for r in licence_report(documents(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = [(p, label) for phrase, label in BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_templates_by_position(documents):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = {r["doc_id"]: r for r in scan_licences(documents((0, "x y " + gpl), (1, "licensed gnu version general the public 3 license"), (2, gpl.replace("version 3", "version 9")))).collect()}
    assert [(f["label"], f["place"], f["score"]) for f in rows[0]["found"]] == [("gpl-3", 2, 1.0)]
    assert rows[1]["found"] == [] and rows[2]["found"] == []


def test_rare_words_are_looked_up_first():
    ix = Index({b"gnu": 5.0, b"the": 0.1})
    assert ix.rank(b"gnu") < ix.rank(b"the") < ix.rank(b"unknown")


def test_awkward_rows(awkward, clashing, empty):
    rows = licence_report(awkward).collect()
    assert len(rows) == awkward.count() == licence_report(clashing).count()
    assert all(r["n_words"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert licence_report(empty).count() == 0
