"""Joins, dedup, decontamination, the classifier and the pipeline, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier, substring_dedup, textkernels
from quern.llm.apart import apart
from quern.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, h string"


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "h") for i, t in zip(ids, texts, strict=True)], DOCS)


def words_of(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


# -- components ------------------------------------------------------------------


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# -- n-gram join -------------------------------------------------------------------


def brute_components(texts, width, percent):
    def shingles(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in low.replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width, percent, block", [(4, 85, 512), (5, 80, 3), (3, 60, 8)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(width)
    common = words_of(r, 40)
    texts = []
    for _ in range(25):
        base = words_of(r, r.choice([2, 6, 30, 120, 200]))
        if r.random() < 0.5:
            base = common + base  # a passage that many documents share
        texts += [" ".join(edited(r, base, r.choice([0, 1, 2, 5]))) for _ in range(r.randint(1, 5))]
    hot = words_of(r, 80)
    texts += [" ".join(edited(r, hot, r.choice([0, 1, 1, 2]))) for _ in range(40)] + [" ".join(hot)] * 20
    texts += [None, "", " \t\n", "one", "ONE", "One two", "x" * 5000]
    got = ngram_join.join_components(docs_of(spark, texts), width, percent).collect()
    want = brute_components(texts, width, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == dict(enumerate(want)) and len(got) == len(texts)


def test_ngram_join_on_odd_tables(spark):
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    df = docs_of(spark, ["a b c d e", "a b c d e", None, "a b c d e", "x y z", long, long + " end", None], [7, 7, None, None, 7, 5, 6, 8])
    out = sorted(map(tuple, ngram_join.join_components(df).collect()), key=str)
    assert out == sorted([(7, 1, 7), (7, 1, 7), (None, 0, None), (None, 1, None), (7, 1, 7), (5, 9000, 5), (6, 9001, 5), (8, 0, 8)], key=str)
    assert ngram_join.join_components(df.where("false")).count() == 0


def test_levels_count_all_documents_of_a_token(spark):
    texts = ["one two three four five"] * 70 + [f"{i} alone in here {i}" for i in range(50)] + ["six six six six"] * 17 + [None, ""]
    table = ngram_join._levels(docs_of(spark, texts).repartition(3), 4)
    hot, = ngram_join.sets(pa.array(["one two three four five"]), 4)
    mild, = ngram_join.sets(pa.array(["six six six six"]), 4)
    assert table[ngram_join._slots(hot)].tolist() == [3, 3] and table[ngram_join._slots(mild)].tolist() == [1] and (table > 0).sum() == 3


def test_tokens_are_shuffled_once(spark, monkeypatch):
    """Counting and joining shared prefix tokens read the shuffle that dealt them by token."""
    plans = {}
    real = ngram_join.durable

    def durable(df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(ngram_join, "durable", durable)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.join_components(docs_of(spark, ["a b c d e f g"] * 3 + ["a b c d e f h"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plans["ngram-entries"].split("\n") if "Exchange" in x and "h#" in x]
    assert dealt and all("REPARTITION_BY_COL" in x for x in dealt)


def test_only_texts_in_question_are_shuffled(spark, monkeypatch):
    """With lists too long to broadcast, texts that no key concerns stay where they are, in all three joins."""
    import corpus_pipeline

    base = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(60)]
    docs = docs_of(spark, [*base, *(b + " end" for b in base[:3]), None], [*range(63), None])
    plans = {}
    real = ngram_join.durable

    def durable(df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(ngram_join, "durable", durable)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = corpus_pipeline.near_copies(spark, docs, SF)
        lines = line_dedup.dedup_lines(docs_of(spark, [*base, *base[:3], None], [*range(63), None]))
        plans |= {"near": near._jdf.queryExecution().executedPlan().toString(), "lines": lines._jdf.queryExecution().executedPlan().toString()}
        assert sorted((x["doc_id"] for x in near.collect()), key=str) == sorted([*range(60), None], key=str)
        assert sorted((x["doc_id"] for x in lines.collect()), key=str) == sorted([*range(60), None], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("LeftSemi" in plans[k] and "BroadcastHashJoin" in plans[k] for k in ("ngram-sets", "near", "lines"))
    may, rest = apart(docs, F.col("doc_id"), spark.range(5))
    assert {*range(5)} <= {x["doc_id"] for x in may.collect()} and may.count() + rest.count() == 64 and may.count() < 10


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_structured_words_have_other_hashes():
    flip = str.maketrans("ab", "ba")
    words = [x for n in (64, 256, 1024, 8192) for x in (thue_morse(n), thue_morse(n).translate(flip))]
    found = [s.tolist() for s in ngram_join.sets(pa.array(words), 4)]
    assert len({x for s in found for x in s}) == len(words)


# -- line dedup ----------------------------------------------------------------------


def test_patience_alignment_is_common_and_increasing():
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 15))] for _ in range(2))
        out = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in out)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(out, out[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.common_blocks([1, 2, 3, 4], [9, 2, 3, 8, 4], {3}, [1] * 5) == [1, 2]


def test_line_dedup(spark):
    rare = "a line that only two documents have\nand the line that comes after it"
    common = "a line of five words everywhere"
    texts = [f"{common}\nfirst\n{rare}\nend of one", f"start of two\n\n{rare}\n{common}\nown end", None, "", f"{common}"] + [f"{common}\nunique number {i}" for i in range(30)]
    texts += ["copy of\nthree whole lines of\ntext here"] * 25  # copies, though no line of theirs is rare
    df = docs_of(spark, texts).union(docs_of(spark, ["lonely"], [None]))
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df).collect()}
    assert out[0] == texts[0] and out[1] == f"start of two\n\n{common}\nown end"
    assert out[2] is None and out[3] == "" and out[None] == "lonely" and all(out[5 + i] == texts[5 + i] for i in range(30))
    assert out[35] == texts[35] and not any(i in out for i in range(36, 60))
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_equals_all_pairs(spark):
    r = random.Random(13)
    pool = [" ".join(words_of(r, r.randint(3, 12), 500)) for _ in range(150)]
    blocks = [r.sample(pool, r.randint(2, 6)) for _ in range(12)]
    texts = []
    for _ in range(60):
        own = [" ".join(words_of(r, 8, 10**6)) for _ in range(r.randint(1, 8))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(own))
            own[at:at] = r.choice(blocks)
        texts.append("\n".join(own + r.sample(pool, r.randint(0, 3))))
    texts += [texts[3], "\n".join(reversed(texts[5].split("\n")))]
    texts = ["\n".join(reversed(b)) for b in blocks] + texts  # earlier documents with the same lines scattered
    lines = [[x for x in t.split("\n") if x] for t in texts]
    df = {}
    for t in lines:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = {x["doc_id"]: {int(k) for k in x["deleted"].split(",") if k} for x in _op2(spark, docs_of(spark, texts)).collect()}
    rare = {x for x, n in df.items() if n <= line_dedup.RARE and len(x.split()) >= line_dedup.EVIDENCE_WORDS}
    code = {x: i for i, x in enumerate(df)}
    few = missed = 0
    for i, b in enumerate(lines):
        every, first = set(), set()
        for a in lines[:i]:
            evidence = {code[x] for x in set(a) & set(b) & rare}
            gone = set(line_dedup.common_blocks([code[x] for x in a], [code[x] for x in b], evidence, [len(x.split()) for x in b]))
            every |= gone
            first |= gone if evidence else set()
        # All pairs by rare lines are there; blocks of frequent lines are aligned with their least holder.
        assert first <= out[i] <= every, i
        missed += len(every - out[i])
        few += len(every)
    assert few > 150 and missed <= 0.05 * few


def test_shortest_runs_of_lines():
    r = np.random.default_rng(3)
    words, offsets = r.integers(0, 26, 60), np.array([0, 7, 7, 8, 40, 60])
    got = set(zip(*(x.tolist() for x in line_dedup.shortest_runs(words, offsets)), strict=True))
    want = set()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        enough = [(i, j) for i in range(a, b) for j in range(i + 1, b + 1) if words[i:j].sum() >= line_dedup.BLOCK_WORDS]
        want |= {min((x for x in enough if x[0] == i), key=lambda x: x[1]) for i in {x[0] for x in enough}}
        want |= {max((x for x in enough if x[1] == j), key=lambda x: x[0]) for j in {x[1] for x in enough}}
    assert got == want


def test_equal_runs_have_equal_parts_wherever_they_stand(spark):
    r = random.Random(9)
    pool = [" ".join(words_of(r, 7, 500)) for _ in range(6)]
    texts = ["\n".join(r.choices(pool, k=r.randint(1, 9))) for _ in range(80)]
    parts = {}
    for x in line_dedup._parts(line_dedup.line_table(docs_of(spark, texts)).coalesce(1)).collect():
        parts.setdefault(x["row"]["doc_id"], set()).add(x["part"])
    runs = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} | {("whole", *t)} for t in (x.split("\n") for x in texts)]
    assert all(len(parts[i]) == len(runs[i]) for i in range(80))
    assert all(len(parts[i] & parts[j]) == len(runs[i] & runs[j]) for i in range(80) for j in range(i))


def test_frequent_lines_have_all_their_partners(spark):
    """Blocks in more than RARE documents, each two of whose lines an earlier document holds apart; and one long line."""
    block = [f"boiler plate line {x} is here today" for x in "abcd"]  # 7 words each: no two lines are enough words
    long = " ".join(f"w{i}" for i in range(60))
    apart = [[block[0], block[1]], [block[1], block[2]], [block[2], block[3]]]
    texts = ["\n".join([*x, f"own {i}"]) for i, x in enumerate(apart)]
    texts += ["\n".join([f"head {i}", *block, f"tail {i}"]) for i in range(20)]
    texts += ["\n".join([f"top {i}", long, f"bottom {i}"]) for i in range(20)]
    out = {x["doc_id"]: x["deleted"] for x in _op2(spark, docs_of(spark, texts)).collect()}
    assert [out[i] for i in range(4)] == [""] * 4 and {out[i] for i in range(4, 23)} == {"1,2,3,4"}
    assert out[23] == "" and {out[i] for i in range(24, 43)} == {"1"}


def _op2(spark, df):
    lines = line_dedup._prepared(df)
    out = lines.select("row.doc_id", "row").join(line_dedup.deletions(lines), "row", "left")
    return out.select("doc_id", F.array_join(F.coalesce("gone", F.array().cast("array<int>")), ",").alias("deleted"))


def test_line_dedup_on_odd_tables(spark):
    block = [f"line number {i} of a block that is shared by some" for i in range(6)]
    texts = ["\n".join(block[::-1]), "\n".join(["first", *block, "end"]), "\n".join(["other", *block, "tail"]), "\n".join(["again", *block]), "alone here", None, "\n".join(f"{i}" for i in range(20_000)) + "\n" + "\n".join(block)]
    df = docs_of(spark, texts, [0, 1, 2, 2, 2, 2, 9]).withColumnsRenamed({"key": "gone", "n": "_id", "h": "_row0"})
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    rows = sorted((x["doc_id"], x["text"]) for x in out.where("text IS NOT NULL").collect())
    second = [x for x in rows if x[0] == 2]
    assert sorted(len(t.split("\n")) for _, t in second) == [1, 1, 2] and out.where("text IS NULL").count() == 1
    assert dict(rows)[9].count("\n") == 19_999


def test_line_numbers_count_empty_lines(spark):
    row = line_dedup.line_table(docs_of(spark, ["\n\na b\n\nc"])).first()
    assert row["places"] == [2, 4] and row["words"] == [2, 1]


# -- passages ----------------------------------------------------------------------


def test_compact_windows_are_the_min_hash_groups():
    r = np.random.default_rng(4)
    values = r.integers(0, 50, 60).astype(np.uint64) << np.uint64(20)
    begin, end = np.array([0, 30, 30]), np.array([30, 30, 60])
    owner, left, c, right = substring_dedup.compact_windows(values, begin, end, 5)
    for seg in (0, 2):
        nodes = [(a, m, b) for o, a, m, b in zip(owner, left, c, right) if o == seg]
        for i in range(begin[seg], end[seg]):
            for j in range(i + 5, end[seg] + 1):
                held = [(a, m, b) for a, m, b in nodes if a <= i <= m < j <= b]
                assert len(held) == 1 and held[0][1] == i + int(values[i:j].argmin())


def test_repeated_passages(spark):
    r = random.Random(6)
    passage, other = words_of(r, 60), words_of(r, 120)
    fill = lambda n: words_of(r, n, 10**6)
    texts = [" ".join(fill(70) + passage + fill(90))]
    texts += [" ".join(fill(r.randint(0, 200)) + passage + fill(r.randint(0, 200))) for _ in range(12)]
    texts += [" ".join(fill(50) + edited(r, other, k) + fill(50)) for k in (0, 1, 2)]
    texts += [" ".join(fill(300)) for _ in range(10)] + [" ".join(passage[:40] + fill(100)), None, "", "short"]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {x["doc_id"] for x in out} == {*range(1, 13), 14, 15}
    for x in out:
        a = (texts[x["doc_id"]].split())[x["start_word"] : x["end_word"]]
        b = (texts[x["other_id"]].split())[x["other_start"] : x["other_end"]]
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 <= len(b) and abs(len(s & t) / len(s | t) - x["similarity"]) < 1e-5 and x["similarity"] >= 0.8
    assert all(x["other_id"] == 0 and x["end_word"] - x["start_word"] >= 60 for x in out if x["doc_id"] < 13)
    assert substring_dedup.repeated_passages(docs_of(spark, texts).where("false")).count() == 0


def test_passages_whose_leader_holds_half(spark):
    r = random.Random(16)
    texts = []
    for _ in range(30):
        passage, fill = words_of(r, 50, 10**6), lambda n: words_of(r, n, 10**6)
        texts += [" ".join(fill(80) + passage[:25] + fill(80)), " ".join(fill(60) + passage + fill(60)), " ".join(fill(90) + passage + fill(30))]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(x["doc_id"], x["other_id"]) for x in out} == {(3 * i + 2, 3 * i + 1) for i in range(30)}


def test_passages_behind_several_leaders(spark):
    r = random.Random(17)
    passage, fill = words_of(r, 60, 10**6), lambda n: words_of(r, n, 10**6)
    texts = [" ".join(fill(60) + passage[15 * (i % 4) : 15 * (i % 4) + 15] + fill(60)) for i in range(32)]
    texts += [" ".join(fill(60) + passage + fill(60)) for _ in range(3)]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {x["doc_id"] for x in out} == {33, 34} and all(x["end_word"] - x["start_word"] >= 60 for x in out)


def test_passages_quoted_in_part_by_an_earlier_document(spark):
    r = random.Random(18)
    fill = lambda n: words_of(r, n, 10**6)
    held = [fill(60) for _ in range(60)]
    texts = [" ".join(w for p in held for w in p[:40] + fill(5))]
    texts += [" ".join(fill(40) + p + fill(r.randint(0, 90))) for p in held for _ in range(2)]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    pairs = {(2 * i + 2, 2 * i + 1) for i in range(60)}
    assert {(x["doc_id"], x["other_id"]) for x in out} <= pairs
    assert len({x["doc_id"] for x in out}) >= 0.95 * len(pairs)


def test_passages_at_the_threshold(spark):
    r = random.Random(20)
    fill = lambda n: words_of(r, n, 10**6)
    texts = []
    for i in range(150):
        p = fill(50)
        q = [*p[:5], *fill(5), *p[5:]] if i % 3 == 0 else p[:]  # 41 of 46 shingles of the longer one's rest
        if i % 3 == 1:
            q[r.randint(4, 45)] = fill(1)[0]  # five of 46 shingles differ: 41 of 51
        elif i % 3 == 2:
            q = p[:45] + fill(5)  # 41 shingles in one run
        texts += [" ".join(fill(40) + x + fill(40)) for x in (p, q)]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(x["doc_id"], x["other_id"]) for x in out} == {(2 * i + 1, 2 * i) for i in range(150)}


def test_passages_of_many_documents_with_one_line(spark):
    r = random.Random(21)
    fill = lambda n: words_of(r, n, 10**6)
    line = fill(24)
    held = [fill(40) for _ in range(12)]
    texts = [" ".join(fill(60) + line + held[i % 12] + fill(60)) for i in range(24)]
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(x["doc_id"], x["other_id"]) for x in out} == {(i + 12, i) for i in range(12)}


def test_pairs_of_a_line_or_a_repeated_word_are_not_compared(spark, monkeypatch):
    r = random.Random(23)
    fill = lambda n: words_of(r, n, 10**6)
    line, held = fill(24), fill(60)
    texts = [" ".join(fill(60) + (line if i % 2 else ["the"] * r.randint(18, 44)) + fill(60)) for i in range(60)]
    # Two that only the last step compares: one line with all others, one passage with each other.
    texts += [" ".join(fill(60) + line + held + fill(60)) for _ in range(2)]
    compared, texts_of = [], substring_dedup._texts_of

    def counted(docs, pairs, *rest):
        compared.append(pairs.count())
        return texts_of(docs, pairs, *rest)

    monkeypatch.setattr(substring_dedup, "_texts_of", counted)
    out = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(x["doc_id"], x["other_id"]) for x in out} == {(61, 60)}
    assert sum(compared) <= 3 * len(texts)


def test_windows_are_made_and_dealt_once(spark):
    r = random.Random(25)
    docs = docs_of(spark, [" ".join(words_of(r, 80, 10**6)) for _ in range(4)])
    plan = substring_dedup._keyed(substring_dedup._windows(docs, 16))._jdf.queryExecution().executedPlan().toString()
    # Texts are cut into windows once; windows are dealt by signature, then by key.
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_texts_of_many_pairs_are_cut_once(spark, monkeypatch):
    r = random.Random(26)
    held = words_of(r, 60, 10**6)
    text = " ".join(held)
    known, cut, shingled = {}, [], substring_dedup._shingled
    monkeypatch.setattr(substring_dedup, "_shingled", lambda column: cut.append(len(column)) or shingled(column))
    for _ in range(3):
        known = substring_dedup._known(pa.record_batch({"other_id": pa.array([7, 7, 9]), "a": pa.array([text, text, "few words"])}), known)
    assert sum(cut) == 2 and len(known[7][0]) == 56 and len(known[9][0]) == 0
    assert (known[7][0][known[7][1]] == known[7][2]).all()


def test_passages_at_spots_are_those_that_meet_them():
    r = np.random.default_rng(24)
    a = r.permutation(10**6).astype(np.uint64)[:900]
    for gap in (9, 14, 20, 31):
        b = a.copy()
        for i in range(gap, len(b), gap):
            b[i] += np.uint64(2 * 10**6)
        x, y = (textkernels.shingles(w, substring_dedup.WIDTH) for w in (a, b))
        whole = substring_dedup.passages(x, y, 46, 0.8)
        for place in range(0, len(y), 57):
            near = substring_dedup.passages(x, y, 46, 0.8, [(place, place)])
            assert any(s <= place < e for s, e, *_ in near) or not any(s <= place < e for s, e, *_ in whole) or y[place] not in x


def test_passages_against_all_intervals():
    r = np.random.default_rng(22)
    found = []
    for i in range(24):
        a = r.permutation(1000).astype(np.uint64)[:28]
        part = a[2 : 2 + r.integers(14, 24)].copy()
        if i % 2:
            part[r.integers(0, len(part))] += np.uint64(5000)
        b = np.concatenate([r.integers(2000, 3000, 4).astype(np.uint64), part, r.integers(3000, 4000, 4).astype(np.uint64)])
        x, y = (textkernels.shingles(w, substring_dedup.WIDTH) for w in (a, b))
        spans = [[set(w[k:m].tolist()) for k in range(len(w)) for m in range(k + 12, len(w) + 1)] for w in (x, y)]
        best = max((len(p & q) / len(p | q) for p in spans[0] for q in spans[1]), default=0)
        found.append(bool(substring_dedup.passages(x, y, 12, 0.8)))
        assert found[-1] == (best >= 0.8)
    assert {True, False} == set(found)


def test_passages_on_odd_tables(spark):
    r = random.Random(19)
    passage = " ".join(words_of(r, 60, 10**6))
    long = " ".join(words_of(r, 50_000, 10**6))
    df = docs_of(spark, [passage, passage, passage, long + " " + passage, passage + " " + passage, None], [3, 3, None, 5, 6, 7])
    assert {(x["doc_id"], x["other_id"]) for x in substring_dedup.repeated_passages(df).collect()} | {(6, 5)} == {(5, 3), (6, 3), (6, 5)}


# -- decontamination -----------------------------------------------------------------


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    r = random.Random(7)
    items = [(i, " ".join(words_of(r, n))) for i, n in enumerate((20, 40, 60, 12, 3))] + [(9, "Short one here"), (10, None), (11, "tiny")]

    def noisy(text, share):
        out = list(text)
        for _ in range(int(len(text) * share)):
            at = r.randrange(len(out))
            out[at : at + 1] = r.choice([[], ["q"], [out[at], "z"]])
        return "".join(out)

    texts = [" ".join(words_of(r, 50)) + " " + noisy(items[k][1], s).upper() + "\n" + " ".join(words_of(r, 50)) for k in range(4) for s in (0, 0.03, 0.08, 0.2)]
    texts += ["x short  ONE\there y", None, "", " ".join(words_of(r, 400)), items[2][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leak_rows(docs_of(spark, texts), bench).collect()
    want = set()
    for d, t in enumerate(texts):
        for i, item in items:
            item, text = decontaminate.normal(item), decontaminate.normal(t)
            if len(item) >= decontaminate.MIN_CHARS and text and edit_distance_inside(item, text) <= (int(len(item) * 0.1) if len(item) >= 20 else 0):
                want.add((d, i))
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert decontaminate.leak_rows(docs_of(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.leak_rows(docs_of(spark, ["x"]).where("false"), bench).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leak_rows(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2500)
    assert sorted(map(tuple, decontaminate.leak_rows(docs, bench).collect())) == whole and whole


# -- classifier ------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality_classifier.fit(docs, labels.where(seen))
    held = quality_classifier.resample(quality_classifier.score(docs, model).select("doc_id", "log_weight"), least=model.least).join(labels.where(~seen), "doc_id")
    by = {(x["quality"], x["toxic"]): x["kept"] for x in held.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1, 0] > 0.95 and by[0, 0] < 0.08 and by[1, 1] < 0.55  # a third of the toxic labels are wrong


def test_top_k_equals_sorting(spark):
    r = random.Random(8)
    rows = [(i, r.choice([0.0, -1.0, r.gauss(0, 3)])) for i in range(500)] + [(None, 0.0), (3, -50.0)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double")
    key = quality_classifier.gumbel_key(F.col("log_weight"), F.col("doc_id"))
    order = [x["k"] for x in df.select(key.alias("k")).orderBy(F.desc("k")).collect()]
    for k in (0, 1, 37, 250, len(rows), 9999):
        kept = quality_classifier.resample(df, k).where("kept").select(key.alias("k")).collect()
        assert sorted((x["k"] for x in kept), reverse=True) == order[: max(0, min(k, len(rows)))]


def test_classifier_on_odd_tables(spark):
    df = docs_of(spark, ["a b", None, "", "a b", "a b " * 300_000]).withColumnsRenamed({"key": "log_weight", "h": "kept"})
    labels = spark.createDataFrame([(0, 1, 0), (9, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        model = quality_classifier.fit(df, some)
        out = quality_classifier.resample(quality_classifier.score(df, model), least=model.least)
        assert out.count() == 5 and out.where("kept").count() == 5 and sorted(out.columns) == sorted(df.columns)
    empty = df.where("false")
    assert quality_classifier.resample(quality_classifier.score(empty, model)).count() == 0


def test_weights_equal_brute_force(spark):
    import math

    r = random.Random(21)
    texts = [" ".join(words_of(r, r.randint(1, 30), 12)) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, texts)
    model = quality_classifier.fit(df, labels)
    back = {x["doc_id"] for x in labels.where(F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(4)) == 0).collect()}
    fitted = [t.split() for i, t in enumerate(texts) if i < 40 and i % 3 > 0 and i % 5 and i not in back]
    every = [t.split() for t in texts]
    tables = []
    for n, size in ((1, quality_classifier.WORDS), (2, quality_classifier.PAIR_BUCKETS)):
        grams = lambda docs: [tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1)]  # noqa: B023, E731
        t, w = grams(fitted), grams(every)
        tables.append({g: math.log((t.count(g) + 1) / (len(t) + size)) - math.log((w.count(g) + 1) / (len(w) + size)) for g in set(w)})
    off = 0
    for x in quality_classifier.score(df, model).collect():
        d = texts[x["doc_id"]].split()
        one, two = ([t[tuple(d[i : i + n])] for i in range(len(d) - n + 1)] for n, t in zip((1, 2), tables))
        want = 256 * (sum(one) / max(1, len(one)) + 0.3 * sum(two) / max(1, len(two)))
        off += abs(want - x["log_weight"]) > 1e-6
    assert off <= 12  # pairs of words that share one of the hashed buckets


# -- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from quern.llm.durable import durable

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = durable(stages["quality classifier"](spark, docs, SF), "t")
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    lined = durable(stages["line dedup"](spark, kept, SF), "t")
    assert lined.columns == columns
    before, after = ({x["doc_id"]: x["text"] for x in d.collect()} for d in (kept, lined))
    assert set(after) <= set(before) and all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after)
    near = durable(stages["n-gram Jaccard join"](spark, lined, SF), "t")
    ids = sorted(after)
    groups = brute_components([after[i] for i in ids], 5, 80)
    assert sorted(x["doc_id"] for x in near.collect()) == [i for k, i in enumerate(ids) if groups[k][1] == k]
    clean = durable(stages["benchmark decontamination"](spark, near, SF), "t")
    items = [decontaminate.normal(x["text"]) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {x["doc_id"] for x in clean.collect()}
    assert held == {x["doc_id"] for x in near.collect() if not any(i in decontaminate.normal(x["text"]) for i in items)}
    out = {x["doc_id"]: x for x in stages["byte-level BPE"](spark, clean, SF).collect()}
    import public_tokenizers as P

    v = bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert set(out) == held and all(v.decode(np.array(x["ids"])).decode() == after[i] for i, x in out.items())
