"""Decontamination, personal data, URL filter and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitgauge.llm import decontaminate, pii, url_filter
from pitgauge.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice(["ka", "lo", "mi", "ne", "pu", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(1)
    return [(i, " ".join(words(rng, n)) + ". " + " ".join(words(rng, max(3, n // 5))) + ".") for i, n in enumerate([6, 14, 30, 60, 60, 150, 20, 33, 64, 90] * 3)]


def index_of(rows):
    df = Counter(w for _, t in rows for w in set(decontaminate.words_of(t)))
    return decontaminate.build_index(rows, df, len(rows))


def test_block_max_wand_equals_full_scores(benchmark_rows):
    index, rng = index_of(benchmark_rows), random.Random(2)
    vocabulary = sorted(index.terms)
    for o in index.octaves:
        for threshold in (0.05, 0.2, 0.5):
            for _ in range(60):
                item = rng.choice(o.items)
                own = decontaminate.words_of(dict(benchmark_rows)[item])
                query = {index.terms[w] for w in rng.sample(own, rng.randint(1, len(own))) + rng.sample(vocabulary, 10)}
                scores = Counter()
                for t in query:
                    for at, v in zip(*o.postings.get(t, ((), ()))):
                        scores[at] += v
                want = {at: s for at, s in scores.items() if s >= threshold}
                got = dict(decontaminate.block_max_wand(o, sorted(query), threshold))
                assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_window_that_reaches_the_threshold_is_skipped(benchmark_rows):
    index, rng = index_of(benchmark_rows), random.Random(3)
    for _ in range(30):
        text = words(rng, rng.randint(0, 200))
        for _, t in rng.sample(benchmark_rows, 2):
            own = t.split()
            k = rng.randint(1, len(own))
            at = rng.randint(0, len(text))
            text[at:at] = own[:k]
        for o in index.octaves:
            parts = [w for w in decontaminate.words_of(" ".join(text))]
            import numpy as np

            found = {k - 1 for k in decontaminate.windows(np.array([index.terms.get(w, 0) for w in parts], dtype=np.int64), 1 + np.arange(len(parts)) // o.size, o).tolist()}
            for start in range(0, max(1, len(parts) - o.size), o.size):
                query = {index.terms[w] for w in parts[start:start + 2 * o.size] if w in index.terms}
                if decontaminate.block_max_wand(o, sorted(query), 0.5):
                    assert start // o.size in found


def test_leaks_are_found_wherever_they_are(spark, benchmark_rows):
    rng, docs, want = random.Random(4), [], set()
    for i in range(120):
        text = words(rng, rng.choice([0, 5, 300]))
        if i % 3 == 0:
            item, leak = rng.choice(benchmark_rows)
            leak = leak.upper().replace(" ", "\n") if i % 2 else leak
            at = rng.randint(0, len(text))
            text[at:at] = [leak]
            want.add((i, item))
        docs.append((i, " ".join(text)))
    docs.append((200, benchmark_rows[3][1].split(". ")[0]))  # a question without its answer
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(benchmark_rows * 2 + [(900, None), (None, "ka lo"), (901, ""), (902, "  ?!")], "item_id long, text string")
    got = decontaminate.contaminated(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(df, items).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_shards_find_the_same(spark, benchmark_rows, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in benchmark_rows], "doc_id long, text string")
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 10)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()} == whole


def test_decontamination_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat and slept all day")], "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (1, 1), (1, 1)]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(odd_docs, items).collect()} == {None, 2, 3, 4, 5, 6, 7, 8}
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda m: len(re.sub("[^0-9]", "", m.group()))
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)] + [(*m.span(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= n(m) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_spans_are_the_contracts():
    rng = random.Random(6)
    parts = ["a", "1", "25", "256", ".", "@", "+", "-", " ", "(", ")", "%", "b", "_", "\n", "é", "4111 1111 1111 1111", "a.b@c.org", "10.0.0.1", "+1 (243) 555-5526"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def model():
    return pii.learn()


def test_dynamic_program_finds_the_best_segmentation(model):
    def best(tokens, gaps, cells, j):
        if j == 0:
            return 0.0
        return max([best(tokens, gaps, cells, j - 1)] + [best(tokens, gaps, cells, i) + s - model.cost for i, f in cells[j] for s in model.scores(f)])

    rng = random.Random(8)
    for _ in range(40):
        tokens, gaps, _ = pii.example(rng)
        tokens, gaps = tokens[:13], gaps[:13]
        cells = pii.lattice(tokens, gaps)
        got = sum(model.scores(pii.span_features(tokens, gaps, i, j))[pii.KINDS.index(k)] - model.cost for i, j, k in pii.decode(model, tokens, gaps))
        assert abs(got - best(tokens, gaps, cells, len(tokens))) < 1e-6


def test_held_out_sentences(model):
    rng = random.Random(77)
    hit = miss = wrong = 0
    for _ in range(200):
        tokens, gaps, gold = pii.example(rng)
        got = set(pii.decode(model, tokens, gaps))
        hit, miss, wrong = hit + len(got & set(gold)), miss + len(set(gold) - got), wrong + len(got - set(gold))
    assert hit / (hit + miss) > 0.85 and hit / (hit + wrong) > 0.93


def test_loose_forms_are_added_and_plain_text_is_left(model):
    for text, kind in (("write to jane.doe [at] mail [dot] example [dot] com please", "email"), ("call (243) 555-5526 now", "phone"), ("from host 10[.]0[.]20[.]1 today", "ip")):
        spans = pii.added_spans(text, pii.base_spans(text), model)
        assert [k for *_, k in spans] == [kind], (text, spans)
    for text in ("on 2024-05-06 we sold 12 at 30 each", "we met at noon in room 101", "token = \"04dbebab91ab85687d33eeaaf\"", "version 1.2.3 of 4 parts"):
        assert pii.added_spans(text, pii.base_spans(text), model) == []


def test_long_runs_of_digits_and_words(model):
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 50_000, "+" * 50_000 + "1", "@" * 50_000):
        pii.base_spans(text)


def test_a_long_table_of_numbers_is_one_window_of_little_memory(model):
    import random
    import tracemalloc

    rng = random.Random(8)
    rows = [" ".join(str(rng.randrange(10 ** rng.randint(1, 6))) for _ in range(6)) for _ in range(1_500)]
    text = "\n".join([*rows, "call (243) 555-5526 now", *rows])
    tracemalloc.start()
    spans = pii.added_spans(text, pii.base_spans(text), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text) and any(k == "phone" and text[a:b] == "(243) 555-5526" for a, b, k in spans)


def test_windows_read_token_by_token_equal_the_whole_lattice(model):
    import random

    rng = random.Random(6)
    tokens, gaps = [], []
    for _ in range(120):
        t, g, _ = pii.example(rng)
        tokens += t
        gaps += [False, *g[1:]]
    cells = pii.lattice(tokens, gaps)
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i in range(max(0, j - pii.LONGEST), j):
            f = dict(cells[j]).get(i)
            assert f is None or f == pii.span_features(tokens, gaps, i, j)
        for i, f in cells[j]:
            for k, s in zip(pii.KINDS, model.scores(f)):
                if best[i] + s - model.cost > best[j] + 1e-12:
                    best[j], back[j] = best[i] + s - model.cost, (i, k)
    want, j = [], len(tokens)
    while j:
        if back[j]:
            want.append((back[j][0], j, back[j][1]))
        j = back[j][0] if back[j] else j - 1
    assert len(tokens) > 1_500 and pii.decode(model, tokens, gaps) == want[::-1]


def test_short_and_long_items(spark):
    """Short items have to stand together; a long item costs short texts nothing; shards of one item give what one shard gives."""
    items = spark.createDataFrame([(1, "red fox"), (2, "what is the capital of france? paris is the capital."), (3, " ".join(f"w{i}" for i in range(3_000))), (4, "the the the fox the the the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the fox is red and red is the fox"), (2, "a Red, fox!"), (3, "x " * 40 + "what is the capital of france paris is the capital" + " y" * 40), (4, " ".join(f"w{i}" for i in range(3_000)))]
                                 + [(10 + i, f"short text {i}") for i in range(50)], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert {(r[0], r[1]) for r in got} == {(2, 1), (3, 2), (4, 3)}
    before = decontaminate.SHARD_ITEMS, decontaminate.SHARD_BYTES
    try:
        decontaminate.SHARD_ITEMS, decontaminate.SHARD_BYTES = 2, 1_000
        assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == got
    finally:
        decontaminate.SHARD_ITEMS, decontaminate.SHARD_BYTES = before


def test_personal_data_after_long_runs(model):
    assert pii.added_spans("1 " * 3_000, [], model) is not None


def test_personal_data_odd_rows(odd_docs, no_docs, model):
    rows = pii.digest_personal_data(odd_docs, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == 10
    for r in rows:
        base = plain_spans(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r["spans"].split(","))
    seven = next(r for r in rows if r["doc_id"] == 7)
    assert (seven["n_email"], seven["n_ip"], seven["n_card"], seven["n_phone"]) == (1, 1, 1, 1)
    clean = pii.redact(odd_docs, model)
    assert clean.columns == odd_docs.columns and clean.count() == 10
    texts = {r["doc_id"]: r["text"] for r in clean.select("doc_id", "text").collect()}
    assert texts[7] == "mail me: <email> or <phone>, card <card>, ip <ip>." and texts[3] is None and texts[2] == ""
    assert len(pii.find_personal_data(odd_docs, model).where("size(base) > 0").collect()) == 1
    assert pii.digest_personal_data(no_docs, model).count() == 0 and pii.redact(no_docs, model).count() == 0


def test_url_parts_and_rules(spark):
    urls = {"http://A.Example.NET/en/x?q=1": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
            "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
            "http://b.org/fr/1#t": ("b.org", "/fr/1", "org/fr/", "allow"), "http://net": ("net", "", None, "allow"), "http://h?x/y": ("h", "", None, "allow"),
            "É://ÀB.net/": ("Àb.net", "/", "net/", "block"), "no scheme/net/": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow")}
    df = spark.createDataFrame([(i, u, "v", 7) for i, u in enumerate(urls)] + [(None, "http://q.net/", "v", 7)], "page_id long, url string, Verdict string, n int")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_filter.judge(df, none, RULES)
    by = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert {u: by[u] for u in urls} == urls and got.count() == len(urls) + 1
    assert url_filter.judge(df.limit(0), none, RULES).count() == 0


def test_reputation_shrinks_small_hosts(spark):
    pages, outcomes = [], []
    for host, n, bad in (("a.good.com", 40, 1), ("b.good.com", 1, 1), ("c.evil.com", 60, 58), ("d.evil.com", 30, 29), ("new.evil.com", 1, None), ("x.other.org", 50, 5), ("y.third.org", 50, 2)):
        for k in range(n):
            pages.append((len(pages), f"http://{host}/{k}"))
            if bad is not None:
                outcomes.append((len(pages) - 1, k < bad))
    df = spark.createDataFrame(pages, "page_id long, url string")
    seen = spark.createDataFrame(outcomes + [(0, None)], "page_id long, bad boolean")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(df, seen, []).collect()}
    assert got["c.evil.com"] == got["d.evil.com"] == "block" and got["a.good.com"] == got["b.good.com"] == got["x.other.org"] == "allow"
    hosts = df.select("page_id", url_filter.host_of(F.col("url")).alias("host")).join(seen, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).na.fill(0)
    mean = {r["host"]: r["mean"] for r in url_filter.reputations(hosts).collect()}
    assert mean["new.evil.com"] > 0.5 and mean["b.good.com"] < 0.6 and mean["c.evil.com"] > mean["d.evil.com"] - 0.05


def test_queries_of_this_package():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("drop", [False, True])
def test_pipeline_stages(spark, tmp_path, drop):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.limit(0) if drop else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.where("not lossless").count() == 0 and (docs.count() > 50) != drop


def test_pipeline_run_equals_its_stages(spark):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op8_toxicity_lexicon"](spark, SF).where("predicted = 1").collect()}
    leaks = {r["doc_id"] for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert ids and not ids & toxic and not ids & leaks


def test_url_query_equals_its_sql(spark):
    from pitgauge.llm.queries import ORACLES
    from tests.parity import compare, connect

    ok, message = compare(spark, connect(SF), QUERIES["op1_url_reputation"], ORACLES["op1_url_reputation"], SF)
    assert ok, message


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_whole_tables(spark, name):
    got = QUERIES[name](spark, SF)
    key = next((c for c in ("doc_id", "page_id", "vec_id") if c in got.columns), None)
    if name.startswith("op4") or key is None:  # findings, and packed rows
        assert got.count() > 0
        return
    source = {"doc_id": "documents", "page_id": "pages", "vec_id": "embeddings"}[key]
    assert got.count() == got.select(key).distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_a_kept_text_is_sent_to_python_once(spark, monkeypatch):
    """Each text of a batch takes memory of the executor and of its worker; the next batch is read when the last one has gone."""
    import weakref

    import pyarrow as pa

    from pitgauge.llm.common import append_columns, field

    docs = spark.createDataFrame([(1, "ab", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, lang string")
    sent, runs = [], []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sent.append(self.schema) or runs.append(f) or real(self, f, schema))
    fields, make = [field("n", "int")], lambda: lambda texts, ids=None: [[len(t) for t in texts]]
    for keep, key, want in ((None, None, 1), (["doc_id"], None, 1), (["lang", "text"], "doc_id", 1)):
        got = append_columns(docs, "text", fields, make, keep=keep, key=key)
        assert [f.dataType.simpleString() for f in sent[-1] if f.name != "key"].count("string") - ("lang" in got.columns) == want
        assert sorted(r.n for r in got.collect()) == [0, 0, 2]
        if "text" in got.columns:
            assert {(r.text, r.n) for r in got.collect()} == {("ab", 2), (None, 0), ("", 0)}
    held = []

    def batches():
        for i in range(3):
            table = pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["ab"]), pa.array(["x"])], names=["c0", "c1", "c2"])
            assert all(ref() is None for ref in held)
            held.append(weakref.ref(table))
            yield table
            del table

    assert len(list(runs[0](batches()))) == 3
