"""Token alignment against byte offsets, filter audit against every order applied to every document."""

import hashlib
import random
from collections import Counter
from functools import cache
from itertools import accumulate, permutations

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vellumflow.llm import filter_audit, oracles, queries, token_alignment as ta
from vellumflow.llm.tokens import byte_signs, default_piece_model, default_tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@cache
def libraries():
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_piece_model())


def spelled(text):
    """(ids, bytes) of both sides by the libraries alone."""
    a, b = libraries()
    back = {s: b for b, s in byte_signs().items()}
    left = a.encode(" " + text, add_special_tokens=False)
    pieces = b.encode(text, out_type=str)
    right = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return left.ids, [bytes(back[c] for c in t) for t in left.tokens], b.encode(text), right


def brute_digests(rows):
    docs = []
    for d, text in rows:
        groups = []
        if text:
            a, x, b, y = spelled(text)
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = [list(accumulate(map(len, t))) for t in (x, y)]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([k for k, at in zip(ids, own, strict=True) if low < at <= e] for ids, own in ((a, ends[0]), (b, ends[1])) for low in [groups[-1][2] if groups else 0]) + (e,))
        docs.append((d, [(g[0], g[1]) for g in groups]))
    counts = Counter((a[-1], b[-1]) for _, groups in docs for a, b in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, groups in docs:
        linked = [(a[-1], b[-1]) for a, b in groups]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(linked), sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked), digest))
    return sorted(out, key=str)


def aligned(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, ta.alignment_digests(df, **more).select(*COLUMNS).collect()), key=str)


def odd_texts(n):
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "a", "The", "\xe9", "é", "<s>", "<|endoftext|>", "　", "日本", "\x00", "\xa0", "\U0001f600", "ﬁ", "\r", "<0x0A>", "<unk>", "\x1c", "'s", "..."]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " "), (4, "▁ is a sign"), (5, "plain"), (5, "plain"), (None, "no id here"), (7, "<|endoftext|> and <s>"), (8, "x " * 3), (9, "ab" * 5000)]


@pytest.mark.parametrize("pair_bytes", [ta.PAIR_BYTES, 0])
def test_alignment_against_offsets(spark, sf_dir, pair_bytes):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    rows = EDGES + [(100 + k, t) for k, t in enumerate(odd_texts(120) + [t[:3000] for t in texts])]
    assert aligned(spark, rows, pair_bytes=pair_bytes) == brute_digests(rows)


def test_alignment_of_a_very_long_text_and_of_none(spark):
    text = " ".join(f"word{k % 977}" for k in range(50_000))
    (got,) = aligned(spark, [(1, text)])
    assert got[1] > 50_000 and got[3] == got[4] > 0
    assert aligned(spark, []) == []


def test_aligned_table_spells_the_texts(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts(50))]
    own = ta.aligner(default_tokenizer(), default_piece_model())
    texts = dict(rows)
    table = ta.align_texts(spark.createDataFrame(rows, "doc_id long, text string"), default_tokenizer(), default_piece_model())
    for r in table.collect():
        for ids, known in zip((r["a_ids"], r["b_ids"]), own.machine.bytes, strict=True):
            assert b"".join(known[k] for k in ids) == (" " + texts[r["doc_id"]]).encode()
        assert sum(r["a_sizes"]) == len(r["a_ids"]) and sum(r["b_sizes"]) == len(r["b_ids"])


def test_transducer_by_hand():
    machine = ta.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abc", b"x"])
    assert machine.align([0, 1], [0, 1]) == ([2], [2])
    assert machine.align([2, 0, 1], [2, 2]) == ([1, 3], [1, 2])
    assert machine.align([0, 1], [0, 3]) is None and machine.align([0], [0]) is None and machine.align([2], [2, 0]) is None
    assert machine.known == len({(s.from_b, s.rest, t) for s in machine.states.values() for t in s})


def brute_audit(docs, labels):
    def fails(d, text):
        words, signs = text.split(), [c for c in text]
        upper = sum("A" <= c <= "Z" for c in signs)
        first = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * upper > 5 * len(signs), "D": bool(set("#$%&*|") & set(text)), "E": first}

    marks = {k: {d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1)}
    judged = [((s or ""), d, fails(d, t or "")) for d, t, s in docs]
    out = []
    for part in {p for p, *_ in judged}:
        own, rows = [(d, f) for p, d, f in judged if p == part], []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone, before = [x for x in left if x[1][c]], len(left)
                left = [x for x in left if not x[1][c]]
                failing = [x for x in own if x[1][c]]
                alone = sum(sum(f.values()) == 1 for _, f in failing)
                rows.append([part, "".join(order), step, before - len(gone), len(gone), len(failing) - len(gone), alone, sum(d in marks[0] for d, _ in gone), sum(d in marks[1] for d, _ in gone)])
        total = Counter()
        for r in rows:
            total[r[1][r[2] - 1]] += r[4]
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, filter_audit.audit_filters(df, marked).collect()))


def audit_rows(n):
    rng = random.Random(8)
    pool = ["one two", "Three FOUR $", " ".join(f"w{k}" for k in range(60)), " ".join("ab" for _ in range(70)), "", None, "#", "A" * 20, " ".join(f"W{k}" for k in range(55)) + " &", "\xc9 " * 60]
    return [(k, rng.choice([*pool, f"own {k}"]), rng.choice(["p", "q", "", None])) for k in range(n)]


def test_audit_against_every_order(spark):
    docs = audit_rows(120)
    docs += [docs[0], docs[0], (None, "one two", "p"), (None, None, None), (500, " ".join(f"w{k % 3000}" for k in range(40_000)), "long")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 130, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    labels = [(d, int(a), int(b)) for d, a, b in labels]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_empty_tables_and_clashing_names(spark):
    assert audited(spark, [], []) == []
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3)], "doc_id long, text string, source string, digest int, n int, part int")
    marked = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(df, marked).count() == 600


def test_words_are_counted_without_another_shuffle(spark, sf_dir):
    texts = filter_audit.texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    plan = filter_audit.word_totals(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["op12_ngram_join", "op13_filter_audit"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
