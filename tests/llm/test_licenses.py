import re

import pytest

from strandline.llm import license_templates as L

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Words and phrase places as the definition says them."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode())
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "", "x", "Released under the MIT License.", "mit-license MIT license mit license", "Apache License, Version 2.0", "cc by cc by", "CC-BY 4.0", "gnu general public license version 3 or later",
    "é_mit license", "mit  \n license", "the apache\x00license", "kmit license", "Übung CC BY-NC 4.0. end", "license mit",
]


def test_words_and_phrases_equal_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(98, None), (None, "cc by")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t or "")
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.scan_licenses(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "text,label",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("(Released under the MIT License)", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Copyright (c) 2020 Jane Q. Public\n\n" + L._MIT_BODY.replace("<<optional>>(including the next paragraph)<</optional>>", ""), "mit"),
        (L._MIT_BODY.replace("<<optional>>", "").replace("<</optional>>", ""), "mit"),
    ],
)
def test_templates_accept(text, label):
    out = L.standard().scan("before " + text + " after")
    assert label in out[5].split(",") and out[6] == 1.0 and out[7] >= 1


def test_mandatory_wording_must_match_exactly():
    body = L._MIT_BODY.replace("<<optional>>(including the next paragraph)<</optional>>", "")
    out = L.standard().scan(body.replace("sublicense", "lease"))
    assert "mit" not in out[5].split(",") and 0 < out[6] < 1


def test_markup():
    a = L.compile_template("t", "one <<optional>>two <<var words=0-2>> three<</optional>> four <<var words=1-2>> five")
    ok = ["one four x five", "one two three four x five", "one two a b three four x y five"]
    bad = ["one two four x five", "one four five", "one two a b c three four x five", "four x five", "one four x y z five"]
    assert all(a.run(L.words_of(s), 0)[0] == len(s.split()) for s in ok)
    assert all(a.run(L.words_of(s), 0)[0] is None for s in bad)
    for wrong in ("<<optional>>x", "<<what>>x", "<<optional>>x<</optional>>"):
        with pytest.raises(ValueError):
            L.compile_template("t", wrong)


def test_whole_texts_match_only_whole():
    for label, text in [("isc", L._ISC_BODY), ("bsd-2-clause", L._BSD_HEAD + " " + L._BSD_TAIL), ("unlicense", L._UNLICENSE), ("apache-2.0-notice", L._APACHE_NOTICE), ("agpl-3.0-notice", L._GNU_NOTICE.format(name="Affero", version="3")), ("mit", L._MIT_BODY)]:
        plain = text.replace("<<optional>>", "").replace("<</optional>>", "")
        for least in range(9):
            plain = plain.replace(f"<<var words={least}-{12 if least == 1 else {0: 1, 2: 6, 4: 8}.get(least, 0)}>>", " ".join(["acme"] * max(least, 1)))
        plain = plain.replace("<<var words=4-6>>", "a b c d")
        labels = L.standard().scan("intro " + plain + " outro")[5].split(",")
        assert label in labels, (label, labels)
        words = plain.split()
        cut = L.standard().scan(" ".join(words[:-1]))
        assert label not in cut[5].split(",") and cut[6] <= 1.0, label
        wrong = L.standard().scan(" ".join([*words[:-4], "changed", *words[-3:]]))
        assert label not in wrong[5].split(","), label
