import re

from tessera.llm.license_scan import PHRASES, license_scan
from tessera.llm.license_scan import op8_license_scan as op8

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute(documents):
    found = []
    for i, text in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for label, phrase in PHRASES:
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        found.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(found, key=repr)


def test_phrases(docs, rows, spark, tmp_path):
    documents = [
        (1, "Released under the MIT License."), (2, "Under-the_mit/license under THE mit license, under the MIT licence"), (3, None), (4, ""), (5, "cc by"), (6, "CC BY-NC 4.0; cc by nc cc by nc"),
        (7, "Apache License, Version 2.0 " * 200), (None, "cc by nc"), (7, "cc by nc"), (7, "cc by nc"), (8, "ünder the mit license éapache license version 2"), (9, "under the mit"),
        (10, "word " * 50_000 + "under the mit license"), (11, "under the mİt license"), (12, "apache license version 2under the mit license"),
    ]
    at = f"{tmp_path}/documents.parquet"
    docs(*documents).write.parquet(at)
    found = op8(spark, str(tmp_path))
    assert rows(found, *COLUMNS) == brute(documents)
    assert {tuple(r) for r in found.where("doc_id = 1").select("labels", "score").collect()} == {("mit", 1.0)}
    assert all(0 <= r.score <= 1 for r in found.collect())


def test_notices_bear_edits(docs):
    text = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:"
    spans = license_scan(docs((1, f"Some words first. {text}"), (2, "redistribution and use in source"), (3, "This work is licensed under the GNU General Public License, version 3.")))
    assert {(r.doc_id, r.label, r.first_word) for r in spans.collect() if r.label} == {(1, "bsd", 3), (3, "gpl-3", 6)}


def test_other_phrases_and_empty_table(docs):
    spans = license_scan(docs((1, "a b c d a b c d")), phrases=[("x", "a b c d"), ("y", "b c d")], notices=[])
    assert sorted((r.label, r.first_word) for r in spans.collect()) == [("x", 0), ("x", 4), ("y", 1), ("y", 5)]
    assert license_scan(docs()).count() == 0


def test_only_ascii_letters_are_lower_cased(docs):
    spans = license_scan(docs((1, "KILO watt hour"), (2, "Kilo watt hour"), (3, "kilo WATT Hour")), phrases=[("x", "kilo watt hour")], notices=[])
    assert sorted(r.doc_id for r in spans.collect() if r.label) == [1, 3]
