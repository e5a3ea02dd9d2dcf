"""Kernels, byte-level BPE, personal data, quality rules, licences and preference pairs."""

import base64
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, license_scan, pii, preference_format, quality_rules
from quern.llm import queries as Q
from quern.llm.textkernels import NEWLINE, SPACE, column_bytes, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string"


def docs_of(spark, texts):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else "en", "s", 0, "k", "h") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(Q.queries()[name], Q.oracle_sql()[name])


def test_runs_equal_split():
    r = random.Random(1)
    texts = ["".join(r.choice("aB é\n\t\x0b漢 ") for _ in range(r.randint(0, 30))) for _ in range(300)]
    data, offsets = column_bytes(pa.array([*texts, None]))
    for table, pattern in ((SPACE, "[^\x20\x09-\x0d]+"), (NEWLINE, "[^\n]+")):
        start, end, hashes, first = runs(data, offsets, table)
        want = [re.findall(pattern, t) for t in texts] + [[]]
        got = [[data[a:b].tobytes().decode() for a, b in zip(start[x:y], end[x:y])] for x, y in zip(first, first[1:])]
        assert got == want
        by_text = {}
        for a, b, h in zip(start, end, hashes):
            assert by_text.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(by_text.values())) == len(by_text)


def test_runs_cut_long_texts_at_separators(monkeypatch):
    from quern.llm import textkernels

    text = "word " * 500 + "x" * 900 + " end"
    data, offsets = column_bytes(pa.array(["a b", text]))
    whole = runs(data, offsets)
    monkeypatch.setattr(textkernels, "PIECE", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, runs(data, offsets)))


# -- BPE -----------------------------------------------------------------------

ALPHABET = " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0 'sstreveld abcXYZ019é漢字😀́!?._-²Ⅷ\x00"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, reference):
    r = random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["", None, "a" * 3000, " " * 500, "漢字" * 300, "x!" * 100, "<|endoftext|>", "a b"] * 2
    df = docs_of(spark, texts)
    ids = bpe.encode(df)
    assert ids.columns == [c for c in df.columns if c != "text"] + ["ids"]
    for row in bpe.decode(ids).collect():
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == reference.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_bpe_steps_don_t_change_ids(monkeypatch, reference):
    import public_tokenizers as P

    vocabulary = bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    r = random.Random(4)
    texts = ["".join(r.choice("ab c d'st é\n") for _ in range(r.randint(0, 400))) for _ in range(60)]
    monkeypatch.setattr(bpe, "STEP_BYTES", 100)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    flat, n = vocabulary.encode(*column_bytes(pa.array(texts)))
    assert flat.tolist() == [i for t in texts for i in reference.encode_ordinary(t)] and n.tolist() == [len(reference.encode_ordinary(t)) for t in texts]
    slow = bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), "(?:" + P.PATTERN + ")")
    assert not slow.fast and slow.encode(*column_bytes(pa.array(texts)))[0].tolist() == flat.tolist()


def test_pieces_with_equal_hashes_stay_apart(monkeypatch, reference):
    import public_tokenizers as P

    vocabulary = bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    text = "a"
    while len(text) < 8192:
        text += text.translate(str.maketrans("ab", "ba"))
    texts = [x for n in (1024, 8192) for x in (text[:n], text[:n].translate(str.maketrans("ab", "ba")))]
    for _ in range(2):
        flat, n = vocabulary.encode(*column_bytes(pa.array(texts)))
        assert flat.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]
    monkeypatch.setattr(bpe, "hash_runs", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    vocabulary._forget()
    texts = ["some words of no length in particular, and more", "other words", "words other"]
    for _ in range(2):
        flat, n = vocabulary.encode(*column_bytes(pa.array(texts)))
        assert flat.tolist() == [i for t in texts for i in reference.encode_ordinary(t)] and n.tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_bpe_digests_and_empty_table(spark, reference):
    row = bpe.digests(bpe.encode(docs_of(spark, ["hello world"]).select("doc_id", "text"))).first()
    ids = reference.encode_ordinary("hello world")
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.digests(bpe.encode(docs_of(spark, ["x"]).where("false"))).count() == 0


# -- personal data ---------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def good(kind, s):
        digits = re.sub(r"\D", "", s, flags=re.A)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    for _ in range(20000):
        text = "".join(r.choice(["a", "b.", "@", "_", "1", "22", ".", "+", "-", " ", "(", "é", "4539 1488 0343 6467", "25", "9"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 30000 + "." * 10 + "a" * 30000) == []  # linear on long runs


def test_bootstrapping_finds_unseen_forms(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon number {i}" for i in range(30)] + ["please call me 555-010-2233 today", "the total was 555-010-2299 units", None, "", "please call me 555-010-2233 today"]
    out = {r["doc_id"]: r for r in pii.extract(docs_of(spark, texts)).collect()}
    assert len(out) == len(texts)
    found = lambda i: [texts[i][s["start"] : s["end"]] for s in out[i]["added"]]
    assert found(30) == ["555-010-2233"] == found(34) and found(31) == [] and out[32]["base"] == []
    assert all(len(out[i]["base"]) == 1 for i in range(30))
    assert pii.extract(docs_of(spark, ["x"]).where("false")).count() == 0


def test_copies_count_alike_on_both_sides_of_a_pattern(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon" for i in range(10)] + ["please call me +1 555 010 9999 soon"] * 200 + ["please call me 555-010-2233 today"]
    out = {r["doc_id"]: r for r in pii.extract(docs_of(spark, texts)).collect()}
    assert not any(out[i]["added"] for i in range(210))
    assert [texts[210][s["start"] : s["end"]] for s in out[210]["added"]] == ["555-010-2233"]


def test_what_a_round_finds_induces_patterns_in_the_next(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon" for i in range(20)]
    new = [f"(555) 013-{2000 + i}" for i in range(6)]
    texts += [f"please call me {x} today" for x in new] * 2 + [f"hotline open {x} always" for x in new]
    texts += ["hotline open 555 014 7777 tonight", "the total was 555 015 9999 units", " " * 3000 + "call me" + " " * 2500 + "555-016-1234", "x" * 5000 + " hotline open 555-017-1234"]
    out = {r["doc_id"]: r for r in pii.extract(docs_of(spark, texts)).collect()}
    found = lambda i: [texts[i][s["start"] : s["end"]] for s in out[i]["added"]]
    n = len(texts)
    assert all(found(i) for i in range(20, n - 4))  # recall of identifiers beside patterns of seeds
    assert (found(n - 4), found(n - 3), found(n - 2), found(n - 1)) == (["555 014 7777"], [], ["555-016-1234"], ["555-017-1234"])


def test_spans_and_licences_belong_to_rows(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon" for i in range(20)] + ["please call me 555-010-2233 today", "unrelated", "please call me 555-010-2234 today", None]
    df = spark.createDataFrame(list(zip([*range(20), 100, 100, None, None], texts)), "doc_id long, text string")
    rows = [(r["doc_id"], len(r["added"])) for r in pii.extract(df).where("doc_id = 100 OR doc_id IS NULL").collect()]
    assert sorted(rows, key=str) == sorted([(100, 1), (100, 0), (None, 1), (None, 0)], key=str)
    mit = dict((i, t) for i, t in license_scan.KNOWN if len(t) > 500)["MIT"]
    df = spark.createDataFrame([(1, mit), (1, "nothing here"), (None, mit), (None, None), (1, mit)], "doc_id long, text string")
    rows = [(r["doc_id"], r["licence_id"]) for r in license_scan.report(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, "MIT"), (1, "MIT"), (1, None), (None, "MIT"), (None, None)], key=str)


def test_digests_of_long_licences(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    names |= {i: i for i, _ in license_scan.KNOWN_DIGESTS}
    texts = [(p.name, p.read_text().upper().replace(", ", "  ")) for p in sorted(folder.glob("*")) if not p.is_symlink() and p.name in names]
    if not texts:
        pytest.skip("no public licence texts on this machine")
    df = spark.createDataFrame(texts, "doc_id string, text string")
    assert {r["doc_id"]: r["licence_id"] for r in license_scan.report(df).collect()} == {n: names[n] for n, _ in texts}


def test_known_licences_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do as you like,\nbut do it well.")
    known = license_scan.known_from(spark, str(tmp_path))
    row = license_scan.report(docs_of(spark, ["DO AS YOU LIKE but do it well"]), known).first()
    assert row["licence_id"] == "Own-1.0"


# -- quality rules ---------------------------------------------------------------


def test_quality_rules_on_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    texts = [f"{clean} w{k}" for k in range(40)] + [None, "", "a b c " * 40, " ".join(f"x###{i}" for i in range(90)), "l m\nl m\n\nl m", clean.replace(" ", "\t")]
    df = docs_of(spark, texts)
    rows = {r["doc_id"]: r for r in quality_rules.judge(df.union(df.where("doc_id = 0"))).collect()}
    assert all(rows[i]["kept"] for i in range(40)) and rows[45]["kept"]
    assert rows[40]["n_words"] == 0 and rows[40]["base_failed"] and rows[42]["base_failed"] and rows[42]["n_repeat_words"] == 120
    assert not rows[43]["kept"] and not rows[43]["base_failed"] and rows[43]["n_symbols"] == 270
    assert rows[44]["n_dup_lines"] == 2 and rows[44]["n_repeat_words"] == 6
    assert quality_rules.judge(df.where("false")).count() == 0


def test_thresholds_follow_each_group(spark):
    r = random.Random(9)
    rows = []
    for source, per in (("plain", 0), ("code", 12)):
        for i in range(200):
            words = [f"w{r.randrange(10**6)}" for _ in range(100)]
            for k in r.sample(range(100), per + r.randrange(3) * (per > 0)):
                words[k] += "#"
            rows.append((len(rows), " ".join(words), "en", source))
    rows += [(1000, " ".join(f"x{i}#" if i < 12 else f"x{i}" for i in range(100)), "en", source) for source in ("plain", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sketch = quality_rules.sketches(quality_rules._rates(quality_rules.counts(df, keep=["doc_id", "lang", "source"])))
    fence = {x["source"]: x["f_symbols"] for x in quality_rules.thresholds(sketch, 20).collect()}
    assert fence["plain"] == 0 and 130_000 <= fence["code"] <= 200_000
    kept = {(x["doc_id"], x["source"]): x["kept"] for x in quality_rules.judge(df).collect()}
    assert kept[1000, "code"] and not kept[1000, "plain"] and sum(kept.values()) >= 380


def test_sketches_merge_by_adding(spark):
    df = docs_of(spark, [" ".join("ab" for _ in range(n)) for n in range(60, 100)])
    rated = quality_rules._rates(quality_rules.counts(df.fillna(""), keep=["doc_id", "lang", "source"]))
    whole = quality_rules.sketches(rated)
    parts = quality_rules.sketches(rated.where("doc_id < 17")).union(quality_rules.sketches(rated.where("doc_id >= 17"))).groupBy("lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


# -- licences --------------------------------------------------------------------


def test_licence_digests(spark):
    mit = dict((i, t) for i, t in license_scan.KNOWN if len(t) > 500)["MIT"]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(", ", " ; ") + "\nAll rights reserved."
    texts = [changed, mit + " and more", "some text\nlicensed under CC BY-NC 4.0\nmore", None, "", "!!!\n(c) 2020 x", changed]
    rows = {r["doc_id"]: r for r in license_scan.report(docs_of(spark, texts)).collect()}
    assert rows[0]["licence_id"] == "MIT" == rows[6]["licence_id"] and rows[1]["licence_id"] is None
    assert (rows[2]["notices"], rows[2]["n_notices"], rows[2]["licence_id"]) == ("CC-BY-NC-4.0", 1, None)
    assert all((rows[i]["licence_id"], rows[i]["notices"]) == (None, "") for i in (3, 4, 5))
    assert license_scan.report(docs_of(spark, ["x"]).where("false")).count() == 0


# -- preference pairs --------------------------------------------------------------


def test_preference_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "b"), ("user", "c")]),
        (2, [("user", "hi")], [("user", "hi")]),
        (3, [("user", "é")], None),
        (4, [("assistant", "yo")], [("user", "hi")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, chosen {turn}, rejected {turn}")
    out = {r["conv_id"]: r for r in preference_format.format_pairs(df).collect()}
    assert out[1]["n_prompt_turns"] == 1 and out[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    a, b = map(int, out[1]["chosen_mask"].split(":"))
    assert out[1]["chosen"][a:b] == "a<|im_end|>" and out[1]["rejected_mask"].count(":") == 1
    assert (out[2]["n_prompt_turns"], out[2]["chosen"], out[2]["rejected"]) == (1, "", "")
    assert out[3]["prompt"] == "" and out[3]["rejected"] == "" and out[3]["chosen_mask"] == ""
    assert out[4]["n_prompt_turns"] == 0 and out[4]["chosen_mask"] != ""


def test_conversations_with_odd_rows(spark):
    rows = [(0, 1, "assistant", "b<|im_end|>"), (0, 0, "user", None), (0, 0, "user", None), (1, 0, None, "x"), (None, 0, "user", "y"), (2, 0, "assistant", "solo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in preference_format.format_pairs(preference_format.neighbour_pairs(df)).collect()}
    assert sorted(out) == [0, 1, 2] and out[0]["chosen"].count("<|im_end|>") == 3 and "b< |im_end|>" in out[0]["chosen"]
    assert preference_format.neighbour_pairs(df.where("false")).count() == 0
