"""The queries of the problems on training data, with their SQL statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import BLANKS, UNKNOWN_TEXTS, iso, six_digits, token, utc_day
from tidemark.llm.packing import pack_each
from tidemark.llm.subjects import subject_posteriors
from tidemark.llm.survivors import normalised, pivot_back, survivors, trust_votes, unpivot
from tidemark.llm.tokenizer import round_trips, token_ids, token_sizes
from tidemark.session import bounded_broadcast, cut_lineage
from tidemark.sources.tables import table, with_symbol

HALF_LIFE_SECONDS = 90 * 86_400
SURVIVOR_FIELDS = ["aum", "fund_company", "fund_name", "iopv", "list_date", "management_fee", "nav", "shares", "tracking_index"]


def _judged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates with their policy, age and whether they have expired; sources outside the policy have no rank."""
    policy = table(spark, folder, "resolution_policy").select("field_name", token("source").alias("_source"), "precedence_rank", "max_age_seconds")
    rows = table(spark, folder, "field_candidates").select(
        six_digits("symbol").alias("fund"), "as_of", "field_name", "candidate_id", "value", token("source").alias("_source"), token("freshness").alias("_fresh"),
        F.coalesce("snapshot_at", "available_time").alias("seen_at"), "ingest_time", "provider_payload_hash",
    )
    rows = rows.join(bounded_broadcast(policy), ["field_name", "_source"], "left")
    age = (F.unix_micros("as_of") - F.unix_micros("seen_at")) / F.lit(1_000_000)
    expired = (
        F.when(F.col("_fresh").isin("fresh", "not_applicable"), False)
        .when(F.col("_fresh") == "expired", True)
        .otherwise(F.col("max_age_seconds").isNotNull() & F.coalesce(age > F.col("max_age_seconds"), F.lit(True)))
    )
    return rows.withColumn("age", age).withColumn("expired", expired)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving candidate of each fund, as_of and field with at least two candidates.

    The stated order is strict, so trust and decay are set by its places: the votes of a value are summed all the same.
    """
    rows = _judged_candidates(spark, folder)
    order = F.struct(~F.col("expired"), -F.col("precedence_rank"), "seen_at", "ingest_time", "provider_payload_hash", -F.col("candidate_id"))
    ranked = F.when(F.col("precedence_rank").isNotNull(), order)
    found = survivors(rows, group=["fund", "as_of", "field_name"], candidate="candidate_id", value=normalised("value"), order=ranked, keep=["candidate_id"])
    return with_symbol(found, folder).select("symbol", iso(utc_day("as_of")).alias("as_of_date"), "field_name", "candidate_id")


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per fund and as_of: in each field the value with the most summed votes, pivoted back.

    A vote is the inverse of the source's rank, halved for every max_age_seconds of age.
    """
    rows = _judged_candidates(spark, folder).withColumn("value", normalised("value"))
    vote = trust_votes(F.lit(1.0) / F.col("precedence_rank"), F.col("age"), F.col("max_age_seconds"))
    order = F.struct(-F.col("precedence_rank"), "seen_at", "ingest_time", "provider_payload_hash", -F.col("candidate_id"))
    found = survivors(rows, group=["fund", "as_of", "field_name"], candidate="candidate_id", value=F.col("value"), vote=vote, order=order, keep=["value"])
    wide = pivot_back(found, ["fund", "as_of"], SURVIVOR_FIELDS)
    return with_symbol(wide, folder).select("symbol", F.unix_seconds("as_of").alias("as_of_second"), *SURVIVOR_FIELDS)


def p1_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One record per fund from all its wide observations: unpivoted, each field's value with the most summed votes, pivoted back.

    A source's trust is the inverse of its rank in the field's policy (0.1 outside it); a vote is halved for every 90 days
    before the latest snapshot of the table.
    """
    rows = table(spark, folder, "etf_metadata_obs").select("meta_seq", six_digits("symbol").alias("fund"), token("source").alias("_source"), F.coalesce("snapshot_at", "available_time").alias("seen_at"), "ingest_time", *SURVIVOR_FIELDS)
    latest = rows.agg(F.max("seen_at").alias("_latest"))  # one row
    policy = table(spark, folder, "resolution_policy").select("field_name", token("source").alias("_source"), "precedence_rank")
    long = unpivot(rows, ["meta_seq", "fund", "_source", "seen_at", "ingest_time"], SURVIVOR_FIELDS)
    long = long.join(bounded_broadcast(policy), ["field_name", "_source"], "left").join(F.broadcast(latest)).withColumn("value", normalised("value"))
    age = (F.unix_micros("_latest") - F.unix_micros("seen_at")) / F.lit(1_000_000)
    vote = trust_votes(F.coalesce(F.lit(1.0) / F.col("precedence_rank"), F.lit(0.1)), age, F.lit(HALF_LIFE_SECONDS))
    found = survivors(long, group=["fund", "field_name"], candidate="meta_seq", value=F.col("value"), vote=vote, order=F.struct("seen_at", "ingest_time", "meta_seq"), keep=["value"])
    return with_symbol(pivot_back(found, ["fund"], SURVIVOR_FIELDS), folder).select("symbol", *SURVIVOR_FIELDS)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ids of every document decode to its text, and their spans cover it."""
    return round_trips(table(spark, folder, "documents"))


def _document_packings(spark: SparkSession, folder: str) -> DataFrame:
    """Packings of all documents: one for each profile's capacity alone, and one for all capacities jointly."""
    sizes = cut_lineage(token_sizes(table(spark, folder, "documents")))  # 16 bytes a document; measured once
    return pack_each(sizes, _packings(spark, folder))


def _packings(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    profiles = sorted((p.capacity_tokens, p.profile) for p in table(spark, folder, "pack_profiles").collect())  # fixed, 3 rows
    return {profile: [capacity] for capacity, profile in profiles} | {"joint": [capacity for capacity, _ in profiles]}


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in containers of each profile's capacity, and of all capacities jointly."""
    return _document_packings(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, by packing and final capacity."""
    each = _document_packings(spark, folder).groupBy("packing", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max("filled_tokens").alias("filled"), F.count("*").alias("pieces"))
    return each.groupBy("packing", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.count_if(F.col("tokens") != F.col("filled")).alias("miscounted"), F.round(F.sum("tokens") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled_share"),
    )


def p8_audit(spark: SparkSession, folder: str) -> DataFrame:
    """For each packing the documents placed, and how many break a rule: not every token once, a needless split, a container over its capacity or miscounted."""
    documents = cut_lineage(token_sizes(table(spark, folder, "documents"))).withColumnRenamed("n_tokens", "size")
    packings = _packings(spark, folder)
    placed = pack_each(documents, packings, size_col="size")
    most = F.element_at(F.create_map(*[F.lit(x) for name, some in packings.items() for x in (name, some[-1])]), F.col("packing"))
    pieces = placed.groupBy("packing", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("pieces"), F.count_distinct("first_token").alias("starts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    each = pieces.join(documents, "doc_id").groupBy("packing").agg(
        F.count("*").alias("documents"),
        F.count_if(~((F.col("n_tokens") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("starts") == F.col("pieces")))).alias("uncovered"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= most)).alias("needlessly_split"),
    )
    containers = placed.groupBy("packing", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.min("capacity_tokens").alias("capacity"), F.max("filled_tokens").alias("filled"))
    wrong = containers.groupBy("packing").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.count_if(F.col("tokens") != F.col("filled")).alias("miscounted"))
    return each.join(wrong, "packing")


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    areas = sorted(r.subject for r in table(spark, folder, "subject_areas").collect())  # fixed, 10 rows
    return subject_posteriors(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), areas)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that each document's claims are directed to."""
    return _subjects(spark, folder).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents, and documents weighted by one over their number of subjects.

    The row ``unassigned`` holds the documents without a subject, so that the weights add up to the corpus.
    """
    found = _subjects(spark, folder).select("subject", "n_subjects").unionByName(spark.createDataFrame([("unassigned", None)], "subject string, n_subjects int"))
    by_subject = found.rollup("subject").agg(F.grouping("subject").alias("_all"), F.count("n_subjects").alias("documents"), F.coalesce(F.sum(1 / F.col("n_subjects")), F.lit(0.0)).alias("weighted"))
    whole = table(spark, folder, "documents").agg(F.count("*").alias("_whole"))  # one row
    rest = F.round(F.col("_whole") - F.col("weighted")).cast("long")
    rows = by_subject.where("_all = 1 OR subject <> 'unassigned'").join(F.broadcast(whole))
    every = F.col("_all") == 1
    return rows.select(F.when(every, "unassigned").otherwise(F.col("subject")).alias("subject"), F.when(every, rest).otherwise(F.col("documents")).alias("documents"), F.round(F.when(every, rest.cast("double")).otherwise(F.col("weighted")), 6).alias("weighted"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_metadata, p7_ids, p7_round_trip, p8_containers, p8_fill, p8_audit, p9_found, p9_composition)}


# --- the same in SQL -------------------------------------------------------------------------------------------------

_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288)"
_UNKNOWN = ", ".join(f"'{t}'" for t in UNKNOWN_TEXTS)
assert len(BLANKS) == 6
_DIGITS = lambda c: f"nullif(regexp_extract(translate({c}, '０１２３４５６７８９', '0123456789'), '(^|[^0-9])([0-9]{{6}})([^0-9]|$)', 2), '')"
_TOKEN = lambda c: f"lower(trim({c}, {_BLANKS}))"

_P1_ROWS = f"""
funds AS (SELECT {_DIGITS('symbol')} AS fund, min(symbol) AS symbol FROM instruments GROUP BY 1),
judged AS (
  SELECT {_DIGITS('c.symbol')} AS fund, c.as_of, c.field_name, c.candidate_id, p.precedence_rank, p.max_age_seconds,
    CASE WHEN {_TOKEN('c.value')} NOT IN ({_UNKNOWN}) THEN trim(c.value, {_BLANKS}) END AS value,
    coalesce(c.snapshot_at, c.available_time) AS seen_at, c.ingest_time, c.provider_payload_hash,
    (epoch_us(c.as_of) - epoch_us(coalesce(c.snapshot_at, c.available_time))) / 1e6 AS age, {_TOKEN('c.freshness')} AS fresh
  FROM field_candidates c LEFT JOIN resolution_policy p ON p.field_name = c.field_name AND {_TOKEN('p.source')} = {_TOKEN('c.source')}
),
candidates AS (
  SELECT DISTINCT *, CASE WHEN fresh IN ('fresh', 'not_applicable') THEN 0 WHEN fresh = 'expired' THEN 1
    WHEN max_age_seconds IS NULL THEN 0 WHEN age > max_age_seconds THEN 1 ELSE 0 END AS expired
  FROM judged WHERE fund IS NOT NULL
),
wanted AS (SELECT fund, as_of, field_name FROM candidates GROUP BY ALL HAVING count(DISTINCT candidate_id) > 1)"""

_P1_FOUND = f"""
WITH {_P1_ROWS}
SELECT symbol, strftime(as_of AT TIME ZONE 'UTC', '%Y-%m-%d') AS as_of_date, field_name, candidate_id
FROM candidates JOIN wanted USING (fund, as_of, field_name) JOIN funds USING (fund)
WHERE value IS NOT NULL AND precedence_rank IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY fund, as_of, field_name
  ORDER BY expired, precedence_rank, seen_at DESC, ingest_time DESC, provider_payload_hash DESC, candidate_id) = 1
"""

_SHORTEST = r"regexp_replace(regexp_replace(CAST(TRY_CAST(replace(value, ',', '') AS DECIMAL(38,12)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
_PLAIN = r"regexp_replace(regexp_replace(lower(value), '\s+', ' ', 'g'), '\bmgmt\b', 'management', 'g')"

_P1_RECORDS = f"""
WITH {_P1_ROWS},
ballots AS (
  SELECT *, CASE WHEN field_name = 'tracking_index' THEN coalesce({_DIGITS('value')}, {_PLAIN}) ELSE coalesce({_SHORTEST}, {_PLAIN}) END AS plain,
    CAST(round(1.0 / precedence_rank * coalesce(pow(0.5::DOUBLE, greatest(age, 0) / max_age_seconds), 1.0) * 1000000) AS BIGINT) AS vote,
    row_number() OVER (ORDER BY precedence_rank DESC, seen_at, ingest_time, provider_payload_hash, candidate_id DESC) AS ord
  FROM candidates JOIN wanted USING (fund, as_of, field_name) WHERE value IS NOT NULL AND precedence_rank IS NOT NULL
),
tally AS (SELECT fund, as_of, field_name, plain, sum(vote) AS votes, max(ord) AS ord FROM ballots GROUP BY ALL),
won AS (SELECT fund, as_of, field_name, arg_max(plain, (votes, ord)) AS plain FROM tally GROUP BY ALL)
SELECT symbol, CAST(epoch_us(as_of) // 1000000 AS BIGINT) AS as_of_second, {', '.join(f"max(plain) FILTER (WHERE field_name = '{f}') AS {f}" for f in SURVIVOR_FIELDS)}
FROM won JOIN funds USING (fund) GROUP BY symbol, as_of
"""

_P1_LONG = " UNION ALL ".join(f"SELECT meta_seq, fund, src, seen_at, ingest_time, '{f}' AS field_name, CAST({f} AS VARCHAR) AS raw FROM obs" for f in SURVIVOR_FIELDS)
_P1_METADATA = f"""
WITH funds AS (SELECT {_DIGITS('symbol')} AS fund, min(symbol) AS symbol FROM instruments GROUP BY 1),
obs AS (SELECT *, {_DIGITS('symbol')} AS fund, {_TOKEN('source')} AS src, coalesce(snapshot_at, available_time) AS seen_at FROM etf_metadata_obs),
latest AS (SELECT max(seen_at) AS newest FROM obs),
long AS (SELECT *, CASE WHEN {_TOKEN('raw')} NOT IN ({_UNKNOWN}) THEN trim(raw, {_BLANKS}) END AS value FROM ({_P1_LONG}) WHERE fund IS NOT NULL),
ballots AS (
  SELECT l.*, CASE WHEN l.field_name = 'tracking_index' THEN coalesce({_DIGITS('value')}, {_PLAIN}) ELSE coalesce({_SHORTEST}, {_PLAIN}) END AS plain,
    CAST(round(coalesce(1.0::DOUBLE / p.precedence_rank, 0.1::DOUBLE) * pow(0.5::DOUBLE, greatest((epoch_us(newest) - epoch_us(seen_at)) / 1e6, 0) / {HALF_LIFE_SECONDS}) * 1000000) AS BIGINT) AS vote,
    row_number() OVER (ORDER BY seen_at, ingest_time, meta_seq) AS ord
  FROM long l CROSS JOIN latest LEFT JOIN resolution_policy p ON p.field_name = l.field_name AND {_TOKEN('p.source')} = l.src WHERE value IS NOT NULL
),
several AS (SELECT fund FROM obs GROUP BY fund HAVING count(DISTINCT meta_seq) > 1),
tally AS (SELECT fund, field_name, plain, sum(vote) AS votes, max(ord) AS ord FROM ballots GROUP BY ALL),
won AS (SELECT fund, field_name, arg_max(plain, (votes, ord)) AS plain FROM tally JOIN several USING (fund) GROUP BY ALL)
SELECT symbol, {', '.join(f"max(plain) FILTER (WHERE field_name = '{f}') AS {f}" for f in SURVIVOR_FIELDS)} FROM won JOIN funds USING (fund) GROUP BY symbol
"""

SQL = {
    "p1_found": _P1_FOUND,
    "p1_records": _P1_RECORDS,
    "p1_metadata": _P1_METADATA,
    "p8_audit": "SELECT packing, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS uncovered, 0::BIGINT AS needlessly_split, 0::BIGINT AS overfull, 0::BIGINT AS miscounted FROM (SELECT profile AS packing FROM pack_profiles UNION ALL SELECT 'joint')",
    "p7_round_trip": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, true AS exact FROM documents",
}
