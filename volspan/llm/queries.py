"""The registered queries opN_<name>: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.llm import bpe as bpe_op
from volspan.llm import chat as chat_op
from volspan.llm import decontaminate as leaks_op
from volspan.llm import fim as fim_op
from volspan.llm import fptree as search_op
from volspan.llm import hosts as hosts_op
from volspan.llm import importance as importance_op
from volspan.llm import jaccard_join as jaccard_op
from volspan.llm import pii as pii_op
from volspan.llm import quality_rules as quality_op
from volspan.llm import secret_scan as secrets_op
from volspan.llm import toxicity as toxicity_op
from volspan.llm import warc as warc_op
from volspan.llm.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_list(spans):
    """kind:start:end of all spans, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_digest(spans, kinds):
    """SHA-256 of the base kinds' spans."""
    return F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def op1_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_op.personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, more = ([F.col(f"pii.n_{k}").alias(f"n_{k}") for k in kinds] for kinds in (pii_op.KINDS, pii_op.ALL_KINDS[len(pii_op.KINDS) :]))
    return found.select("doc_id", *base, base_digest(F.col("pii.spans"), pii_op.KINDS).alias("base_sha256"), span_list(F.col("pii.spans")).alias("spans"), *more)


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    manifest = warc_op.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc_op.read_archives(spark, manifest, path, with_payload=False)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: Equal payloads by their text; the digest in base 32, four characters for every five hex digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""


#: (host, path start, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes are the quality labels of equal ids."""
    judged = hosts_op.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_TWO = ", ".join(f"'{x}'" for x in hosts_op.TWO_LABEL_SUFFIXES)
OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
found AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
own AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM found LEFT JOIN known ON page_id = doc_id GROUP BY host),
labels_of AS (SELECT *, string_split(bare, '.') AS l FROM (SELECT *, regexp_extract(host, '^(?:[^@]*@)?([^:]*)', 1) AS bare FROM own)),
h AS (
  SELECT host, n, k,
         CASE WHEN regexp_full_match(bare, '[0-9.]+') THEN bare WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
         CASE WHEN regexp_full_match(bare, '[0-9.]+') THEN bare WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM labels_of),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mean FROM s),
level AS (SELECT 'h' AS l, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
sums AS (SELECT l, sum(n) AS n, sum(k) AS k, count(*) AS g, sum(k * k / n) AS npp, sum(n * n) AS nn FROM level WHERE n > 0 GROUP BY l),
var AS (
  SELECT l, n, CASE WHEN g >= 2 AND n > g THEN (npp - k * k / n) / (g - 1) END AS b, CASE WHEN n > g THEN (k - npp) / (n - g) END AS w,
         CASE WHEN g >= 2 THEN (n - nn / n) / (g - 1) END AS z FROM sums),
rho AS (SELECT l, n, b IS NULL OR w IS NULL AS few, CASE WHEN b + (z - 1) * w > 0 THEN (b - w) / (b + (z - 1) * w) ELSE 0 END AS r FROM var),
strength AS (SELECT l, CASE WHEN few THEN 2 WHEN r > 0 THEN least(n, greatest(0.01, 1 / r - 1)) ELSE n END AS s FROM rho),
sm AS (SELECT suffix, (v.s * g.mean + s.k) / (v.s + s.n) AS m FROM s, g, strength v WHERE l = 's'),
dm AS (SELECT domain, (v.s * m + k) / (v.s + n) AS m FROM d JOIN sm USING (suffix), strength v WHERE l = 'd'),
post AS (SELECT host, v.s * m + k AS a, v.s * (1 - m) + n - k AS b FROM h JOIN dm USING (domain), strength v WHERE l = 'h'),
bound AS (SELECT host, a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS u FROM post),
judged AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM found JOIN bound USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN u < mean THEN 'block' ELSE 'allow' END AS verdict
FROM judged, g
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_op.jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS h FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
           FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM r JOIN both_ways l ON r.b = l.x)
  SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id FROM s JOIN reach ON doc_id = a
"""


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_op.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands fitted on the texts labelled good."""
    docs = table(spark, sf_dir, "documents")
    whole, chunks = quality_op.fit_bands(docs, table(spark, sf_dir, "labels"))
    return quality_op.quality_rules(docs, keep=["doc_id"], document_bands=whole, chunk_bands=chunks).select("doc_id", "quality.*")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    coded = bpe_op.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)
    return coded.select("doc_id", "bpe.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id") != 2)
    scored = toxicity_op.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_op.secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, more = ([F.col(f"secrets.n_{k}").alias(f"n_{k}") for k in kinds] for kinds in (secrets_op.KINDS, secrets_op.ALL_KINDS[len(secrets_op.KINDS) :]))
    return found.select("doc_id", *base, base_digest(F.col("secrets.spans"), secrets_op.KINDS).alias("base_sha256"), span_list(F.col("secrets.spans")).alias("spans"), *more)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks_op.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Side by side at every shift at which document and item share a run of words. Three substitutions leave a run
#: of 3 equal words in 12 and more, of 2 in 11; shorter items must be equal.
OP10_SQL = r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS d FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS need, CASE WHEN len(w) < 11 THEN 0 ELSE 3 END AS allowed, CASE WHEN len(w) >= 12 THEN 3 ELSE least(len(w), 2) END AS g FROM item WHERE len(w) > 0),
ig AS (SELECT item_id, g, i, array_to_string(w[i + 1 : i + g], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - g + 1)) AS i FROM sized)),
dg AS (SELECT doc_id, g, i, array_to_string(d[i + 1 : i + g], ' ') AS gram FROM (SELECT *, unnest(range(0, len(d) - g + 1)) AS i FROM cut, (SELECT DISTINCT g FROM sized) WHERE len(d) >= g)),
met AS (SELECT DISTINCT doc_id, item_id, dg.i - ig.i AS shift FROM dg JOIN ig USING (g, gram)),
laid AS (SELECT doc_id, item_id, need, allowed,
  list_max(list_transform(range(greatest(0, -shift), least(len(w), len(d) - shift) - need + 1), lambda s: list_sum(list_transform(range(0, need), lambda k: (d[shift + s + k + 1] = w[s + k + 1])::INT)))) AS equal
  FROM met JOIN cut USING (doc_id) JOIN sized USING (item_id))
SELECT doc_id, item_id, max(need)::BIGINT AS n_aligned, max(equal)::BIGINT AS n_equal FROM laid WHERE equal >= need - allowed GROUP BY ALL
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_op.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every pair of an item and a document that share a term, scored and ranked.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_all FROM d WHERE len(ts) > 0),
asked AS (SELECT q, term, count(*) AS repeats FROM (SELECT q, unnest(ts) AS term FROM i) GROUP BY ALL),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), g),
size AS (SELECT r, doc_id, 100 - 25 + ((25 * len(ts)::BIGINT * n_docs) // n_all) AS m FROM d, g WHERE len(ts) > 0),
scored AS (SELECT q, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN size USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim_op.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fim_op.restore(made)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha("fim.output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM t),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle, substr(text, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


#: Two turns of control strings, formatted with the conversations.
CONTROL = r"\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    read = chat_op.read_back(chat_op.format_chats(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Lengths of the marks: "### " role ":\n" opens a block of one role, "</turn>\n" ends it, "<more/>" parts its texts.
OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
        length(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '<more/>', '\m'), '### ', '\h')) AS n,
        length(replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '<more/>', '\m'), '### ', '\h'), chr(10), '\n')) AS n_role FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
        sum(n + CASE WHEN before = role THEN 7 ELSE n_role + 14 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_semi_markov,
        op2_warc_dictionary,
        op3_host_reputation,
        op4_jaccard_join,
        op5_importance_resampling,
        op6_quality_rules,
        op7_byte_bpe,
        op8_toxicity,
        op9_secrets,
        op10_decontamination,
        op11_lexical_search,
        op12_fill_in_middle,
        op13_chat_formatting,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_warc_dictionary": OP2_SQL, "op3_host_reputation": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op10_decontamination": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_chat_formatting": OP13_SQL}
