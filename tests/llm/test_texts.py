"""Licence scan and SentencePiece round trips."""

import numpy as np
import pytest
import sentencepiece

from gridcast.llm import licenses
from gridcast.llm import sentencepiece_codec as sc
from gridcast.llm.vocabulary import DEFAULT_MODEL, Piece, Rules, read_pieces, read_rules

TEXTS = ["Hello  world", " a", "a\nb\tc  ", "ﬁ Å é <s> ", "", "▁x", "　x", "a\x00b", "é", "日本語 テスト 🎉🎉", "    indented     code",
         "a" * 700 + " " + "xyz" * 300, "     ", "½¾ ˙˚ ͸", "Ünïcödé" * 40, "the cat sat on THE mat."]


@pytest.fixture(scope="module")
def codec():
    return sc.Codec(read_pieces(DEFAULT_MODEL), read_rules(DEFAULT_MODEL))


def test_codec_equals_the_library(codec):
    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    for text, ids in zip(TEXTS, codec.encode([t.encode() for t in TEXTS])):
        assert ids.tolist() == sp.encode(text)
        assert codec.decode(ids) == sp.decode(ids.tolist()) == text.replace("▁", " ")


def test_codec_after_its_table_is_cleared(codec, monkeypatch):
    before = [x.tolist() for x in codec.encode([t.encode() for t in TEXTS])]
    monkeypatch.setattr(sc, "KEPT_CHUNKS", 3)
    assert [x.tolist() for x in codec.encode([t.encode() for t in TEXTS])] == before


def test_only_long_chunks():
    fresh = sc.Codec(read_pieces(DEFAULT_MODEL), read_rules(DEFAULT_MODEL))
    text = "q7é" * 200
    assert fresh.encode([text.encode()])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL).encode(text)


def test_edges_are_all_occurrences(codec):
    body = np.frombuffer(b" the other theory\0 th", np.uint8)
    start, length, ids = codec.edges(body)
    raw = body.tobytes()
    want = {(i, len(codec.bytes_of[k]), int(k)) for k in codec.ids for i in range(len(raw)) if raw.startswith(codec.bytes_of[k], i)}
    assert set(zip(start.tolist(), length.tolist(), ids.tolist())) == want
    assert (np.diff(start) >= 0).all()


def test_best_path_of_a_unigram_vocabulary():
    pieces = [Piece("<unk>", 0.0, "control"), *(Piece(t, s, "piece") for t, s in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -4.0), ("▁a", -3.5), ("ba", -3.0), ("aba", -9.0)))]
    codec = sc.Codec(pieces, Rules("unigram", True))
    score = {p.text.replace("▁", " "): p.score for p in pieces[1:]}

    def best(text):
        if not text:
            return 0.0, []
        return max((score[text[:n]] + best(text[n:])[0], [text[:n], *best(text[n:])[1]]) for n in range(1, len(text) + 1) if text[:n] in score)

    for word in ("abab", "bab", "aabba", "abba ab", "b"):
        ids = codec.encode([word.encode()])[0]
        got = [codec.bytes_of[i].decode() for i in ids]
        chunks = [" " + w for w in word.split(" ")]
        assert sum(score[g] for g in got) == pytest.approx(sum(best(c)[0] for c in chunks))
        assert codec.decode(ids) == word


def test_round_trip_table(awkward, empty, rows):
    got = rows(sc.round_trip(awkward))
    assert len(got) == awkward.count()
    for r in got:
        assert r["decoded"] == r["normalized"] == (r["text"] or "").replace("▁", " ")
        assert r["n_tokens"] == len(r["ids"]) and r["row"] in ("r", None)
    assert sc.round_trip(empty).count() == 0


def test_license_scan(spark, rows, awkward, empty):
    mit = licenses.KNOWN[7][1]
    docs = [(1, mit), (2, mit.upper().replace("(c) <YEAR> <COPYRIGHT HOLDERS>", "2024 Somebody Else, all RIGHTS reserved").replace("\n", "\r\n  * ")),
            (3, "Intro.\nReleased  under the MIT licence!\nText"), (4, "We were released under the MIT License. Really"), (5, None), (6, ""),
            (7, "Copyright (c) 2020 Me"), (8, "Licensed under CC BY-NC 4.0.\n\nReleased under the MIT License.\nReleased under the MIT License."),
            (3, "Intro.\nReleased  under the MIT licence!\nText"), (None, "Released under the MIT License.")]
    got = sorted(((r["doc_id"], r["license"], r["notices"], r["n_notices"]) for r in rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))),
                 key=str)
    want = [(1, "MIT", "MIT", 1), (2, "MIT", "", 0), (3, None, "MIT", 1), (3, None, "MIT", 1), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0),
            (7, None, "", 0), (8, None, "CC-BY-NC-4.0,MIT", 2), (None, "MIT", "MIT", 1)]
    simple = [(a, b) for a, b, _, _ in got]
    assert simple == [(a, b) for a, b, _, _ in sorted(want, key=str)]
    assert [g for g in got if g[0] not in (1, 2)] == [w for w in sorted(want, key=str) if w[0] not in (1, 2)]
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(empty).count() == 0


def test_license_before_code_and_in_comments(spark):
    """Runs of consecutive paragraphs: a full text before code, without its title, in comments, in the middle; not in part."""
    texts = dict(licenses.KNOWN)
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and "hereby granted" in t)
    commented = "\n".join("# " + line for line in texts["BSD-3-Clause"].replace("<year>, <owner>", "2021, Somebody").splitlines())
    rows = [(1, mit.replace("<year> <copyright holders>", "2020 Me") + "\n\nimport os\n\nprint(os.name)\n"), (2, commented + "\n\ndef f():\n    return 1\n"),
            (3, "Intro.\n\n" + texts["Zlib"].split("\n\n", 1)[1] + "\n\nThe end."), (4, "\n\n".join(mit.split("\n\n")[:-1]) + "\n\nOther words."),
            (5, "// SPDX-License-Identifier: Apache-2.0\nint main;"), (6, licenses.GNU_NOTICE.format(name="General Public License", version="3", colon=":") + "\nint x;"),
            (7, None), (8, "")]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (None, "MIT") and got[2] == (None, "BSD-3-Clause") and got[3] == (None, "Zlib") and got[4] == (None, "")
    assert got[5] == (None, "Apache-2.0") and got[6] == (None, "GPL-3.0-or-later") and got[7] == got[8] == (None, "")
    whole = licenses.scan(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first()
    assert whole["license"] == "MIT" and whole["notices"] == "MIT"


def test_known_texts_from_a_folder(spark, tmp):
    import os

    os.makedirs(tmp + "/spdx")
    open(tmp + "/spdx/My-1.0.txt", "w").write("First part of it.\n\nSecond part of it.\n")
    known = licenses.read_known(spark, tmp + "/spdx")
    rows = [(1, "head\n\nfirst PART of it\n\nsecond part, of it!\n\ntail"), (2, "first part of it\n\ntail")]
    got = {r["doc_id"]: r["notices"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: "My-1.0", 2: ""}


def test_license_in_a_very_long_text(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and "hereby granted" in t)
    long = "word " * 200_000
    rows = [(1, long + "\n\n" + mit), (2, mit + "\n\n" + long + "\n\nReleased under the MIT License. " + long), (3, long)]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, "MIT"), 2: (None, "MIT"), 3: (None, "")}
