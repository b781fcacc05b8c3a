"""URL reputation, archives, components and the pipeline."""

import base64
import hashlib
import io
import math
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from volspan.llm import components, hosts, quality_rules, warc
from volspan.llm import queries as Q
from volspan.llm.shared import WorkTables, new_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    theirs = sorted(map(str, got.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in Q.QUERIES[name](spark, SF).collect()) == theirs


def test_reputation_sql_on_odd_hosts(spark, tmp_path):
    """Users, ports, addresses and suffixes of two labels, against the SQL."""
    rng = random.Random(3)
    hosts_ = ["a.b.co.uk", "c.b.co.uk", "b.co.uk", "co.uk", "u@x.org:80", "y.x.org", "10.0.0.1", "10.0.0.2:8080", "com", "", "q.com.au", "é.net"]
    pages = [(i, f"http://{rng.choice(hosts_)}/{rng.choice(('en', 'fr', 'es'))}/{i}") for i in range(400)] + [(500, None), (501, "x"), (3, "http://co.uk/")]
    labels = [(i, int(rng.random() < (0.9 if "x" in u else 0.2))) for i, u in pages[:300]] + [(5, 0), (None, 1)]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("good", F.lit(2)).write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = c.execute(Q.OP3_SQL)
    names = [d[0] for d in got.description]
    rows = Q.op3_host_reputation(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r[n] for n in names)) for r in rows) == sorted(map(str, got.fetchall()))
    assert len(rows) == len(pages) and {r.verdict for r in rows} == {"allow", "block"}


def test_url_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/a?b#c", "https://x.net/es/", "x.net/es/", None, "http://a.com", "http://user@H.co.uk:80?q", "ftp://é.NET/fr/ü", "http://net/fr/x", "http://www.example.com/EN/", "a://b://c/d", "://"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge_urls(pages, none, Q.RULES).collect()}
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[1] == ("x.net", "/es/", "net/es/", "block") and got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.com", "", None, "allow") and got[5] == ("user@h.co.uk:80", "", None, "allow")
    assert got[6] == ("é.net", "/fr/ü", "net/fr/", "block") and got[7][2] == "net/fr/" and got[8][2] == "com/" and got[9][:2] == ("b:", "//c/d") and got[10][:2] == ("", "")
    assert hosts.judge_urls(pages.where("false"), none, Q.RULES).count() == 0


def test_shrinkage(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for d, share in (("good.org", 0.95), ("bad.org", 0.05), ("fair.org", 0.8)):
        for h in range(6):
            for _ in range(30):
                i = len(pages)
                pages.append((i, f"http://h{h}.{d}/x"))
                labels.append((i, int(rng.random() < share)))
    pages += [(9000, "http://new.bad.org/"), (9001, "http://new.good.org/"), (9002, "http://other.net/")]
    out = {r.page_id: r for r in hosts.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert out[9000].good_bound < out[9002].good_bound < 1.2 and out[9000].good_bound < out[9001].good_bound
    assert all(out[i].verdict == ("block" if "bad.org" in u else "allow") for i, u in pages if i < 9000)


def test_archives(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = [(i, f"http://h/{i}", "<html>" + " ".join(rng.choice(words) for _ in range(120))) for i in range(200)]
    rows += [(500 + i, "http://copy/", rows[3][2]) for i in range(40)] + [(700, None, None), (701, "", ""), (None, "http://n/\r\nX: y", rows[4][2]), (800, "u", "é\r\n\r\nx" * 5), (800, "u", "é\r\n\r\nx" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc")
    manifest = warc.write_archives(df, path, archive_bytes=40_000)
    out = warc.read_archives(spark, manifest, path).collect()
    assert len(out) == len(rows) == manifest.groupBy().sum("records").first()[0]
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = last.get(h or "") == i
        expected.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else str(last[h or ""]), raw if first else None))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert {r.url for r in out if r.page_id == "700"} == {None} and {r.url for r in out if r.page_id == "701"} == {""}
    # the dictionary leads the file, and every record is a frame of its own
    big = max(manifest.collect(), key=lambda r: r.dictionary_bytes)
    raw = open(big.archive, "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and big.dictionary_bytes > 0
    assert len(list(warc.frames(io.BytesIO(raw)))) == big.records
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + big.dictionary_bytes :])
    none = warc.write_archives(df.where("false"), new_path(spark, "warc"))
    assert none.count() == 0 and warc.read_archives(spark, none, path).count() == 0
    # names that clash with the inner columns, no dictionary, and payloads too short to revisit
    odd = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "v", "long enough " * 2), (4, "v", "long enough " * 2)], "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("same", F.lit("x")).withColumn("payload", F.lit("y")).withColumn("last", F.lit(9))
    path = new_path(spark, "warc")
    out = warc.read_archives(spark, warc.write_archives(odd, path, least_bytes=10), path).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [("1", "response", None), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    with WorkTables(spark) as work:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), work).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    with WorkTables(spark) as work:
        assert components.connected_components(spark.createDataFrame([], "u long, v long"), work).count() == 0
    assert not work.paths


def test_pipeline_on_planted_rows(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [prose(120) for _ in range(10)]
    item = prose(30)
    near = clean[0].split()
    near[5] = "changed"
    texts = [*clean, clean[1], " ".join(near), prose(20) + " " + item + " " + prose(20), prose(5), None, "word " * 300, prose(60) + ' token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"']
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], (None, prose(90), "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "secret scans":
            hidden = {r.doc_id: r for r in docs.collect()}
            assert "[secret]" in hidden[16].text and hidden[16].n_chars == len(hidden[16].text) and hidden[0].text == clean[0]
    # too short, null and repeated words go; then copies; then the benchmark passage
    assert counts == [16, 13, 12, 12, 12]
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == [*range(10), 16]
    assert all(r.round_trip for r in docs.collect())


def test_quality_stage_judges_by_all_good_texts(spark, tmp_path):
    """60,000 good texts, of which 100 compress far better; these are among those that a pick of 50,000 by a hash of the id leaves out."""
    n, press = 60_000, zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    left_out = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= int(50_000 / n * (1 << 30))
    rare = {r.id for r in spark.range(n).where(left_out).orderBy("id").limit(100).collect()}
    plain = " ".join("00000" + c for c in "1000000001011001110111110")  # no eight words twice
    texts = [plain if i in rare else " ".join(f"{i * 7919 * k % 1_000_003:06d}" for k in range(1, 26)) for i in range(n)] + [" ".join(["again"] * 29)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.select("*", F.lit("x").alias("lang"), F.lit("y").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    ratios = np.array([len(press(t.encode())) / 174 for t in texts])
    low, high = np.quantile(np.round(ratios[:n], 4), [0.001, 0.999]) * (1 + (0.02 + 0.5 / math.sqrt(n)) * np.array([-1, 1]))
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == set(np.flatnonzero((ratios >= low) & (ratios <= high)).tolist()) - {n} and rare < kept


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 11))
    assert quality_rules.band(10, quality_rules.DOCUMENT_BANDS) == (0.30, 1.20) and P.PATTERN


def test_reputation_blocks_bad_hosts(spark):
    """Hosts of known shares, one with a third of all pages: those that lie below the crawl are blocked by labels of half their pages,
    and the other half of the labels agrees."""
    rng = random.Random(21)
    share = {f"h{i}.site{i % 20}.{('com', 'net', 'org')[i % 3]}": (0.15 if i % 20 in (3, 7, 11) else 0.9) for i in range(120)} | {"hot.big.com": 0.9, "few.site1.net": 0.0}
    pages, good = [], {}
    for host, p in share.items():
        for _ in range(2_000 if host == "hot.big.com" else 2 if host.startswith("few") else 30):
            good[len(pages)] = int(rng.random() < p)
            pages.append((len(pages), f"https://{host}/x"))
    df = spark.createDataFrame(pages, "page_id long, url string")
    seen = spark.createDataFrame([(i, g) for i, g in good.items() if i % 2], "doc_id long, quality int")
    judged = hosts.judge_urls(df, seen).collect()
    blocked = {r.host for r in judged if r.verdict == "block"}
    assert blocked == {h for h, p in share.items() if p == 0.15}  # two bad pages of a host are too few
    held_out = [good[r.page_id] for r in judged if r.verdict == "block" and r.page_id % 2 == 0]
    assert sum(held_out) / len(held_out) < 0.25
    same = spark.createDataFrame([(i, int(rng.random() < 0.85)) for i in good], "doc_id long, quality int")
    assert sum(r.verdict == "block" for r in hosts.judge_urls(df, same).collect()) < 0.05 * len(pages)  # nothing to tell hosts apart
    assert {r.verdict for r in hosts.judge_urls(df, same, min_good=0.999).collect()} == {"block"}


def test_listed_suffixes(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.z.kobe.jp", "z.kobe.jp", "jp", "10.0.0.1", "", "q.w.unknown", "u@h.site.com:80"]
    df = spark.createDataFrame([(h,) for h in names], "host string")
    listed = spark.createDataFrame([("co.uk",), ("uk",), ("kobe.jp",), ("jp",), ("com",), ("co.uk",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in hosts.listed_suffixes(df, listed).collect()}
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") == got["b.co.uk"] and got["co.uk"] == ("co.uk", "co.uk")
    assert got["x.y.z.kobe.jp"] == ("z.kobe.jp", "kobe.jp") == got["z.kobe.jp"] and got["jp"] == ("jp", "jp")
    assert got["10.0.0.1"] == ("10.0.0.1", "10.0.0.1") and got[""] == ("", "") and got["q.w.unknown"] == ("w.unknown", "unknown") and got["u@h.site.com:80"] == ("site.com", "com")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(names)], "page_id long, url string")
    none = spark.createDataFrame([(None, 1)], "doc_id long, quality int")
    assert hosts.judge_urls(pages, none, suffixes=listed).count() == len(names)
