"""op2, op3, op5, op6, op7 and op10 against brute force, edges of all of them."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vellumflow.llm import license_scan, lm_scoring, mixing, quality_classifier, quality_rules, url_filter
from vellumflow.llm.oracles import oracle_sql
from vellumflow.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that clash with those that the operators make.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rate double, unit string, line int, fail_bits long, m string, score double, bucket int"
REST = (1, 2, 3.0, "u", 4, 5, "m", 0.5, 6)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, *REST) for i, t, s in rows], DOCS)


EDGES = [(1, None, "b"), (2, "", None), (3, "one two", "b"), (3, "one two", "b"), (None, "x y z", "é"), (5, "tab\tand\x0bline\nbreaks  here " * 4000, None), (6, "last words", "Z")]


def targets_by_hand(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (left - sum(fixed.values())) / max(1, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: 2 * sizes[s] for s in over}


def test_mixing_edges(spark):
    rows = [r for r in map(tuple, mixing.mix_ledger(docs_of(spark, EDGES)).collect())]
    assert len(rows) == len(EDGES)
    sizes = defaultdict(int)
    for _, t, s in EDGES:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_by_hand(sizes)
    for doc_id, source, size, source_size, target, rate, copies, taken in rows:
        assert source_size == sizes[source] and math.isclose(target, want[source], abs_tol=1e-9)
        assert copies in (math.floor(rate), math.floor(rate) + 1) and copies <= 2 and taken == copies * size
    mixed = mixing.mix(docs_of(spark, EDGES))
    assert mixed.columns == docs_of(spark, EDGES).columns
    assert mixed.count() == sum(r[6] for r in rows)
    assert mixing.mix_ledger(docs_of(spark, [])).collect() == [] and mixing.mix(docs_of(spark, [])).collect() == []


def test_mixing_takes_near_the_target(spark):
    """Within four deviations of independent draws, and all sources together within one in a hundred."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source")
    got = queries()["op2_mix_sources"](spark, "/root/testdata/sf0.1").join(docs, "doc_id").toPandas()
    taken = target = 0
    for _, g in got.groupby("source"):
        share = g.target.iloc[0] / g.source_size.iloc[0] % 1
        deviation = math.sqrt(float((g["size"].astype(float) ** 2).sum()) * share * (1 - share))
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 4 * deviation + 1
        taken, target = taken + g.taken.sum(), target + g.target.iloc[0]
    assert abs(taken / target - 1) < 0.01


@pytest.mark.parametrize("name", ["op1_exact_top_k", "op2_mix_sources", "op3_license_scan", "op5_quality_rules", "op6_lm_scoring", "rule_ablation", "rule_policies"])
def test_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(oracle_sql()[name]).df()
    got = queries()[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        a, b = got[c].to_list(), want[c].to_list()
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), c


def bigrams_by_hand(text):
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return Counter(zip(words, words[1:], strict=False))


def dice_by_hand(a, b):
    a, b = bigrams_by_hand(a), bigrams_by_hand(b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


MIT = dict(license_scan.all_templates())["MIT"]
PROSE = "The river ran by the old town and nobody knew who had built its bridge of stone. "


def test_licenses(spark):
    notice = next(t for n, t in license_scan.NOTICES if n == "MIT" and len(t) > 200)
    rows = [(1, "Some text.\nRELEASED under the mit licence!\nReleased   under the MIT License", "a"), (1, "Licensed under CC BY-NC 4.0.", "a"), (1, "Licensed under CC BY-NC 4.0.", "a"), (None, "\n".join(notice.split(", ")), "a"), (4, "under the bridge of the town", "a"), (5, None, "a"), (6, "", "a"), (7, "the license " * 20000, "a")]
    got = sorted(map(tuple, license_scan.scan_licenses(docs_of(spark, rows)).collect()), key=str)
    assert (1, "line", 3, "MIT", 1.0) in got and got.count((1, "line", 1, "CC-BY-NC-4.0", 1.0)) == 2
    assert {r[1:4] for r in got if r[0] is None} == {("text", 0, "MIT"), ("window", 1, "MIT")}
    assert {r[0] for r in got} == {1, None}
    assert license_scan.scan_licenses(docs_of(spark, [])).collect() == []


def test_licenses_within_longer_texts(spark):
    """A notice wrapped over lines inside a text, one within a line, and whole licences, as they are and edited."""
    notice = next(t for n, t in license_scan.NOTICES if n == "MIT" and len(t) > 200)
    wrapped = "\n".join(re.findall(r".{1,40}(?:\s|$)", notice))
    whole = dict(license_scan.all_templates())
    rows = [(1, PROSE * 30 + "\n" + wrapped + "\n" + PROSE * 30), (2, PROSE * 5 + "Released under the MIT License. " + PROSE * 5), (3, PROSE * 40)]
    rows += [(10 + k, whole[n]) for k, n in enumerate(("MIT", "BSD-3-Clause", "Apache-2.0", "ISC", "BSD-2-Clause"))]
    rows += [(20, "Copyright 2020 Somebody\n\n" + MIT.replace("authors", "writers").replace("dealings", "doings")), (21, PROSE * 9 + whole["Apache-2.0"] + PROSE * 9)]
    got = [tuple(r) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    first = len(re.findall(r"\w+", PROSE)) * 30 + 1
    assert (1, "window", first, "MIT", 1.0) in got and not [r for r in got if r[0] == 1 and r[1] != "window"]
    assert (2, "window", len(re.findall(r"\w+", PROSE)) * 5 + 1, "MIT", 1.0) in got
    assert not [r for r in got if r[0] == 3]
    for k, n in enumerate(("MIT", "BSD-3-Clause", "Apache-2.0", "ISC", "BSD-2-Clause")):
        assert (10 + k, "text", 0, n, 1.0) in got and (10 + k, "window", 1, n, 1.0) in got
    edited = [r for r in got if r[0] == 20 and r[1] == "text"]
    assert [r[3] for r in edited] == ["MIT"] and math.isclose(edited[0][4], dice_by_hand(rows[-2][1], MIT))
    assert (21, "window", len(re.findall(r"\w+", PROSE)) * 9 + 1, "Apache-2.0", 1.0) in got


def test_licenses_of_own_templates(spark):
    """Ties go to the smaller name; a unit of one bigram counts; pruning loses nothing."""
    own = [("zeta", "a b"), ("alpha", "a b"), ("long", "one two three four five six seven")]
    texts = ["a b", "A, b!", "a", "b a", "x a b y", "one two three four five six", "two three four five six seven eight", "one two four five six seven", "one\ntwo three\nfour five six seven"]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=own).collect()
    lines = {(r["doc_id"], r["place"]): (r["license"], round(r["dice"], 9)) for r in got if r["unit"] != "window"}
    want = {}
    for k, t in enumerate(texts):
        units = t.split("\n")
        for at, u in [*enumerate(units, 1), *([(0, t)] if len(units) > 1 else [])]:
            if len(u.split()) > 1 and (best := min((-round(dice_by_hand(u, x), 9), n) for n, x in own))[0] <= -0.8:
                want[k, at] = (best[1], -best[0])
    assert lines == want and lines[0, 1] == ("alpha", 1.0)
    assert (4, 2, "alpha", 1.0) in {(r["doc_id"], r["place"], r["license"], r["dice"]) for r in got if r["unit"] == "window"}


def windows_by_hand(text, templates, threshold=0.8):
    """Every window of each template's size, best first, without those that overlap a taken one."""
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    pairs, found = list(zip(words, words[1:], strict=False)), {}
    for name, template in templates:
        want = bigrams_by_hand(template)
        size, taken = sum(want.values()), []
        scored = sorted((-sum((Counter(pairs[p : p + size]) & want).values()), p) for p in range(len(pairs)) if pairs[p] in want)
        for c, p in scored:
            if -c / size >= threshold and all(abs(p - q) >= size for q in taken):
                taken.append(p)
                found[p + 1, name] = max(found.get((p + 1, name), 0), -c / size)
    return found


def test_license_windows_by_hand(spark):
    """Copies side by side, overlapping ones, edited ones and repeats within a template; a very long text; a name with an apostrophe."""
    own = [("Author's", "take this and keep this and share this with all"), ("b\\c", "share this with all of them"), ("ten", "one two three four five six seven eight nine ten"), ("ten", "five six seven eight nine ten eleven")]
    ten, rng = own[2][1].split(), random.Random(5)
    texts = ["zz " + " ".join(ten * 2) + " zz", " ".join(ten + ["x"] * 17 + ten), " ".join(ten[:9] * 3 + ten), "take this and " * 40]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(2, 9)):
            piece = rng.choice(own)[1].split()
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = rng.choice(["x", "this", "ten", "and"])
            parts += piece[rng.randrange(3) :] + ["y"] * rng.randrange(3)
        texts.append(" ".join(parts))
    texts.append(" ".join(ten) * 3 + " " + "take this and keep this and share this with all " * 400 + "the quiet river " * 20000)
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=own).filter("unit = 'window'").collect()
    want = {(k, *at): d for k, t in enumerate(texts) for at, d in windows_by_hand(t, own).items()}
    assert {(r["doc_id"], r["place"], r["license"]): r["dice"] for r in got} == want and len(got) == len(want)
    assert [r["place"] for r in sorted(got) if r["doc_id"] == 0 and r["license"] == "ten" and r["dice"] == 1.0][0] == 2
    assert len([r for r in got if r["doc_id"] == 0 and r["license"] == "ten"]) >= 2 and len([r for r in got if r["doc_id"] == len(texts) - 1 and r["dice"] == 1.0]) >= 400
    assert license_scan.scan_licenses(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), templates=[("one", "word")]).collect() == []


def measured_by_hand(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), len(set(words)), len(re.findall("[A-Z]", text)), text.count("!"), len(re.findall("[0-9]", text)))


@pytest.mark.parametrize("text", ["", "a b c", "a b c a b c", "a a a a", "x\nx\n \n\ny\x0bz", "Été # 東京! 12", "w " * 5000, "a b c d a b c e a b c"])
def test_measurements(text):
    assert quality_rules.measured(text.encode()) == measured_by_hand(text)


def test_rules_edges(spark):
    got = quality_rules.rule_ledger(docs_of(spark, EDGES)).collect()
    assert sorted((str(r["doc_id"]), tuple(r[1:11])) for r in got) == sorted((str(i), measured_by_hand(t)) for i, t, _ in EDGES)
    kept = quality_rules.filter_by_rules(docs_of(spark, EDGES), "v1")
    assert kept.columns == docs_of(spark, EDGES).columns and kept.count() == 0
    clash = docs_of(spark, EDGES).withColumnRenamed("m", "rule_ledger")
    ledger = quality_rules.with_ledger(clash)  # the stage's ledger holds all measurements and bits, whatever the policy
    assert ledger.columns == [*clash.columns, "rule_ledger_"]
    assert sorted((str(r["doc_id"]), tuple(r["rule_ledger_"])) for r in ledger.collect()) == sorted((str(r["doc_id"]), tuple(r[1:12])) for r in got)
    assert {r["policy"]: (r["n_kept"], r["n_failed"]) for r in quality_rules.policy_counts(ledger.select("rule_ledger_.fail_bits")).collect()} == {p: (0, len(EDGES)) for p in quality_rules.POLICIES}
    assert quality_rules.rule_ledger(docs_of(spark, [])).collect() == []
    assert quality_rules.ablation(quality_rules.rule_ledger(docs_of(spark, [])), "v1").collect() == []


LM_ROWS = [(1, "a b a b A B", "s"), (2, None, "s"), (3, "", "s"), (None, "a c", "s"), (5, "a c", "s"), (5, "a c", "s"), (7, "lone", "s"), (8, "b a b c a b a b", "s"), (9, "x a b a lone y y y y", "s"), (10, "long text of words " * 3000, "s"), (11, "of words long text", "s")]


def score_by_hand(rows, at, order, own):
    """Stupid backoff of one row by the counts of the others, or of all."""
    texts = [(t or "").lower().split() for _, t, _ in rows]
    counts = Counter(tuple(t[i : i + k]) for j, t in enumerate(texts) if own or j != at for k in range(1, order + 1) for i in range(len(t) - k + 1))
    n, t, out = max(1, sum(len(x) for j, x in enumerate(texts) if own or j != at)), texts[at], 0.0
    for i in range(len(t)):
        longest = min(order, i + 1)
        for k in range(longest, 0, -1):
            if seen := counts[tuple(t[i - k + 1 : i + 1])]:
                out += math.log10(seen / (counts[tuple(t[i - k + 1 : i])] if k > 1 else n) * 0.4 ** (longest - k))
                break
        else:
            out += math.log10(0.4**longest / n)
    return len(t), round(out, 7)


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_lm_scores(spark, order, own):
    got = lm_scoring.lm_scores(docs_of(spark, LM_ROWS), least_buckets=3, order=order, own=own).collect()
    want = [(str(i), *score_by_hand(LM_ROWS, k, order, own)) for k, (i, _, _) in enumerate(LM_ROWS)]
    assert sorted((str(r[0]), r[1], round(r[2], 7)) for r in got) == sorted(want)
    assert lm_scoring.lm_scores(docs_of(spark, []), order=order).collect() == []


def test_lm_counts(spark):
    texts = [(t or "").lower().split() for _, t, _ in LM_ROWS]
    want = Counter((k, tuple(t[i : i + k])) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    got = lm_scoring.ngram_counts(docs_of(spark, LM_ROWS), order=3, least_buckets=4).collect()
    assert len({(r["kind"], r["hash"]) for r in got}) == len(got)
    for k in (1, 2, 3):
        assert sorted(r["n"] for r in got if r["kind"] == k) == sorted(n for (j, _), n in want.items() if j == k)
    assert [r["n"] for r in got if r["kind"] == 0] == [sum(map(len, texts))]


def test_lm_scores_of_many_copies(spark):
    """10^5 rows that are alike: each is another document to the others, and no bucket holds them all."""
    rows = spark.range(0, 100_000, 1, 8).selectExpr("1L AS doc_id", "'one row there is' AS text").unionByName(spark.createDataFrame([(2, "there is one")], "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"], round(r["log_score"], 7)): r["n"] for r in lm_scoring.lm_scores(rows).groupBy("doc_id", "n_words", "log_score").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    n = 4 * 99_999 + 3
    copies = math.log10(100_000 / n * 99_999 / 100_000 * 1 * (99_999 / 99_999))
    other = math.log10(100_000 / 400_000) + 0 + math.log10(0.16 * 100_000 / 400_000)
    assert got.keys() == {(1, 4, round(copies, 7)), (2, 3, round(other, 7))} and got[1, 4, round(copies, 7)] == 100_000
    spread = lm_scoring.dealt(rows, 16 << 20, 16, "doc_id", "text")[0].groupBy("bucket").count().collect()
    assert max(r["count"] for r in spread) < 60_000


def judged_by_hand(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, of, start in url_filter.RULES:
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(of + start) > len(best[0])):
            best = (of + start, verdict)
    return host, path, *(best or (None, None))


URLS = ["http://a.example.org/es/1", "http://example.org/en/1", "https://www.Example.ORG/en/19?x=/de/", "http://badexample.org/es/", "http://x.com/fr/", "http://com/de/9", "ftp://x.com?q=/de/", "http://x.org", "no scheme/de/", None, "", "http://", "://org/#/", "http://É.ORG/x", "http://a.net\n/es/", "http://casino-bets.net/en/4", "http://gardening.net/en/4", "http://" + "long." * 5000 + "net/en/"]


def test_urls(spark):
    df = spark.createDataFrame([(i if i else None, u, "h", "hst", "r", "v", 1.0) for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string, host string, rule string, verdict string, score double")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == 2 * len(URLS)
    by = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        r, (host, path, rule, verdict) = by[i or None], judged_by_hand(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert by[15]["verdict"] == "block" and by[16]["verdict"] == "allow"
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_url_weights_match_gradient_steps(spark):
    import hashlib

    pairs = url_filter.labelled_pairs()[::7]
    labelled = spark.createDataFrame(pairs, "label int, url string")
    weights, bias = url_filter.train(labelled, buckets=512, steps=50)
    order = sorted(pairs, key=lambda p: p[1])
    x = np.zeros((len(order), 512))
    for k, (_, u) in enumerate(order):
        host, path, _, _ = judged_by_hand(u)
        t = f"^{host}${path}"
        for n in url_filter.GRAMS:
            for i in range(len(t) - n + 1):
                x[k, int(hashlib.md5(t[i : i + n].encode()).hexdigest()[:7], 16) % 512] += 1
    y, a, b = np.array([p[0] for p in order], float), np.zeros(len(order)), 0.0
    for _ in range(50):
        e = y - 1 / (1 + np.exp(-(x @ (x.T @ a) + b)))
        a, b = a * (1 - url_filter.RATE * url_filter.RIDGE) + url_filter.RATE * e, b + url_filter.RATE * e.sum()
    assert np.allclose(weights, x.T @ a, atol=1e-9) and math.isclose(bias, b, abs_tol=1e-9)
    assert url_filter.train(labelled.limit(0), buckets=4) == ([0.0] * 4, 0.0)


def test_classifier_on_held_out_rows(spark):
    got = queries()["op10_quality_classifier"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 500 and (held.predicted == held.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_classifier_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit_quality(docs_of(spark, EDGES), empty)
    got = quality_classifier.score_documents(docs_of(spark, EDGES), model).collect()
    assert len(got) == len(EDGES) and {r["score"] for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 0), (3, 0, 0), (6, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit_quality(docs_of(spark, EDGES), labels)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_documents(docs_of(spark, EDGES), model).collect())
    kept = quality_classifier.keep_quality(docs_of(spark, EDGES), model)
    assert kept.columns == docs_of(spark, EDGES).columns
    assert quality_classifier.score_documents(docs_of(spark, []), model).collect() == []


@pytest.mark.parametrize("text", ["", "   ", "One two. Two two!", "a\nb\na\n\n", "É é 12, x;y:z # $", "w " * 9000])
def test_statistics_by_hand(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, raw, chars = max(1, len(words)), text.encode(), max(1, sum(map(len, WORD.findall(text))))
    count = lambda signs: len(re.findall(signs, text))
    letters_digits = count("[A-Za-z0-9]")
    want = [math.log1p(len(words)), chars / n if words else 1.0, count(r"[#*$%&|<>]") / n, count("!") / n, count("[A-Z]") / chars, count("[0-9]") / chars, count("[.,;:]") / n, len(set(words)) / n]
    want += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(words) / max(1, len(lines))]
    beyond = sum(b >= 128 for b in raw)
    want += [(len(raw) - beyond - letters_digits) / max(1, len(raw)), beyond / max(1, len(raw)), math.log1p(len(raw))]
    assert np.allclose(quality_classifier.statistics(raw), want)


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 12, (300, 3)).astype(float), np.zeros(300)
    y = ((x[:, 1] > 6) | (rng.random(300) < 0.1)).astype(float)
    model = quality_classifier.train(x, y, rounds=1, depth=1, bins=64, ridge=1.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    gain = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
    tried = {(f, c): gain(x[:, f] <= c) + gain(x[:, f] > c) for f in range(3) for c in np.unique(x[:, f])[:-1]}
    f, c = max(tried, key=tried.get)
    root = model.roots[0]
    assert (model.feature[root], model.threshold[root]) == (f, c)
    for leaf, rows in ((model.left[root], x[:, f] <= c), (model.right[root], x[:, f] > c)):
        assert math.isclose(model.value[leaf], -0.2 * grad[rows].sum() / (hess[rows].sum() + 1.0))


def test_training_takes_an_id_once(spark):
    """10^5 rows of one labelled id, and conflicting labels of another."""
    many = spark.range(100_000).selectExpr("7L AS doc_id", "concat('copy ', id) AS text", "id AS n")
    docs = many.unionByName(spark.createDataFrame([(1, "good plain words"), (2, "bad !!! ###"), (3, None)], "doc_id long, text string").selectExpr("*", "0L AS n"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (1, 1), (2, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    seen = {}
    real = quality_classifier.train
    quality_classifier.train = lambda x, y, **how: seen.update(x=x, y=y) or real(x, y, **how)
    try:
        quality_classifier.fit_quality(docs, labels)
    finally:
        quality_classifier.train = real
    import zlib

    used = [i for i in (1, 2, 3, 7) if zlib.crc32(str(i).encode()) % 5]
    assert seen["y"].tolist() == [{1: 1, 2: 0, 3: 0, 7: 0}[i] for i in used] and len(seen["x"]) == len(used) and 7 in used


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality_classifier.train(x, y, rounds=20, depth=3)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95

    def one(row):
        total = model.prior
        for root in model.roots:
            at = root
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x[:50]), [one(r) for r in x[:50]])
