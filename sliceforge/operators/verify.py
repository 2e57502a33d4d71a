"""Verification of stored chunks against document records.

    document_info --inline(chunks)--> listed (run, doc_id, id, number, tokens, hash)
    stored chunks --recount, rehash--> (run, doc_id, id, tokens_now, hash_now)
    listed LEFT JOIN stored ON (run, doc_id, id)  -> per-chunk reason
    groupBy run, doc_id: partial aggregates only (count_if, sum, min)

The join key holds the chunk id, so even a document with a third of all chunks
spreads over many tasks; the per-document aggregate is algebraic and combined
map-side, so a hot document never lands whole in one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceforge.functions.tokens import Counter, get_counter

MODES = ("strict", "lenient", "token")


def _keys(document_info: DataFrame, stored: DataFrame) -> list[str]:
    """Documents are told apart by run and id where both tables say the run."""
    return ["run_seq", "doc_id"] if "run_seq" in document_info.columns and "run_seq" in stored.columns else ["doc_id"]


def listed_chunks(document_info: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks each document record claims, with its token total; a record
    with an empty list has one row without a chunk."""
    rows = document_info.withColumn("doc_id", F.col("id")).select(
        *keys, F.col("total_tokens").alias("doc_total"), F.explode_outer("chunks").alias("c")
    )
    return rows.select(
        *keys,
        "doc_total",
        F.col("c.id").alias("chunk_id"),
        F.col("c.number").alias("number"),
        F.col("c.tokens").alias("tokens"),
        F.col("c.content_hash").alias("content_hash"),
    )


def stored_state(stored: DataFrame, counter: Counter, keys: list[str]) -> DataFrame:
    """Read only the keys and the text of the stored chunks; recount and rehash."""
    return stored.withColumn("doc_id", F.col("doc_id").cast("string")).select(
        *keys,
        F.col("id").alias("chunk_id"),
        counter.count(F.col("text")).cast("int").alias("tokens_now"),
        F.md5("text").alias("hash_now"),
    )


REASONS = {1: "missing", 2: "token mismatch", 3: "hash mismatch"}


def _chunk_reason_code(mode: str) -> Column:
    """1 missing, 2 token mismatch, 3 hash mismatch (check order of J2)."""
    missing = F.col("chunk_id").isNotNull() & F.col("hash_now").isNull()
    if mode == "strict":
        return (
            F.when(missing, 1)
            # a recount that failed (null) counts as a mismatch
            .when(F.col("chunk_id").isNotNull() & (F.col("tokens_now").isNull() | (F.col("tokens_now") != F.col("tokens"))), 2)
            .when(F.col("hash_now") != F.col("content_hash"), 3)
        )
    return F.when(missing, 1)


def verify_all_modes(document_info: DataFrame, stored: DataFrame, counter: Counter | str = "regex") -> DataFrame:
    """J1-J5 for all three modes from one join and one aggregate.

    Returns ``run_seq`` (if both tables have it), ``doc_id`` and
    ``reason_strict``, ``reason_lenient``, ``reason_token`` (null = valid).
    ``reason`` (J5) is the first failing check in chunk order.  The first failure
    is ``min(number * 4 + code)``: numeric buffers keep the aggregate a hash
    aggregate with map-side partial results.

    Every record is judged, also one with an empty chunk list: no chunk of it is
    missing, and its total decides in the other modes.  A failed recount (null)
    makes the total of its document wrong.
    """
    counter = get_counter(counter) if isinstance(counter, str) else counter
    keys = _keys(document_info, stored)
    joined = listed_chunks(document_info, keys).join(stored_state(stored, counter, keys), on=[*keys, "chunk_id"], how="left")
    number = F.col("number").cast("bigint")
    per_doc = joined.groupBy(*keys).agg(
        F.max("doc_total").alias("doc_total"),
        F.min(number * 4 + _chunk_reason_code("strict")).alias("first_bad"),
        F.min(F.when(_chunk_reason_code("lenient") == 1, number)).alias("first_missing"),
        F.coalesce(F.sum("tokens_now"), F.lit(0)).alias("sum_now"),  # A8
        F.count_if(F.col("hash_now").isNotNull() & F.col("tokens_now").isNull()).alias("not_counted"),
    )
    code = F.col("first_bad") % 4
    strict_chunk = F.when(code == 1, "missing").when(code == 2, "token mismatch").when(code == 3, "hash mismatch")
    missing = F.when(F.col("first_missing").isNotNull(), F.lit("missing"))
    total_ok = (F.col("not_counted") == 0) & (F.col("sum_now") == F.coalesce("doc_total", F.lit(0)))
    total_bad = F.when(~total_ok, F.lit("total mismatch"))
    return per_doc.select(
        *keys,
        F.coalesce(strict_chunk, total_bad).alias("reason_strict"),
        missing.alias("reason_lenient"),
        F.coalesce(missing, total_bad).alias("reason_token"),
    )


def verify_documents(
    document_info: DataFrame, stored: DataFrame, mode: str = "strict", counter: Counter | str = "regex"
) -> DataFrame:
    """``([run_seq,] doc_id, is_valid, reason)`` for every stored document record.

    * lenient (J1): every listed chunk exists.
    * strict  (J2): exists, recount equal, MD5 equal, recount total equal.
    * token   (J3): exists, recount total equal.
    * other modes: every document invalid (``unknown mode``).
    """
    keys = _keys(document_info, stored)
    if mode not in MODES:
        docs = document_info.withColumn("doc_id", F.col("id")).select(*keys)
        return docs.select(*keys, F.lit(False).alias("is_valid"), F.lit("unknown mode").alias("reason"))
    reason = F.col(f"reason_{mode}")
    return verify_all_modes(document_info, stored, counter).select(*keys, reason.isNull().alias("is_valid"), reason.alias("reason"))


def verification_summary_all(all_modes: DataFrame) -> DataFrame:
    """A6 for every mode from :func:`verify_all_modes`: ``(mode, valid, invalid)``."""
    stack = F.expr("stack(3, 'strict', reason_strict, 'lenient', reason_lenient, 'token', reason_token) as (mode, reason)")
    return all_modes.select(stack).groupBy("mode").agg(
        F.count_if(F.col("reason").isNull()).cast("bigint").alias("valid"),
        F.count_if(F.col("reason").isNotNull()).cast("bigint").alias("invalid"),
    )


def verification_summary(result: DataFrame) -> DataFrame:
    """Number of valid and invalid documents."""
    return result.agg(
        F.count_if(F.col("is_valid")).cast("bigint").alias("valid"),
        F.count_if(~F.col("is_valid")).cast("bigint").alias("invalid"),
    )


# --------------------------------------------------------------------------
# Corruption fixture (deterministic, computable identically in SQL)
# --------------------------------------------------------------------------


def corruption_key(chunk_id: Column) -> Column:
    """First 8 hex digits of MD5(id) as an integer, modulo 97."""
    return F.pmod(F.conv(F.substring(F.md5(chunk_id), 1, 8), 16, 10).cast("bigint"), F.lit(97))


def corrupt_chunks(chunks: DataFrame, extra_word: str = "extra") -> DataFrame:
    """Remove (key 0), re-letter (key 1) or extend (key 2) a subset of chunks.

    Key 1 replaces the first letter by ``Q`` (``Z`` if it is ``Q``): same token
    count, different MD5.  Key 2 appends one word: one more token.
    """
    k = corruption_key(F.col("id"))
    first_letter = F.regexp_extract("text", r"^[^\p{L}]*(\p{L})", 1)
    new_letter = F.when(first_letter == "Q", F.lit("Z")).otherwise(F.lit("Q"))
    relettered = F.regexp_replace(F.col("text"), F.lit(r"^([^\p{L}]*)\p{L}"), F.concat(F.lit("$1"), new_letter))
    text = (
        F.when((k == 1) & (first_letter != ""), relettered)
        .when(k == 2, F.concat(F.col("text"), F.lit(" " + extra_word)))
        .otherwise(F.col("text"))
    )
    return chunks.where(k != 0).withColumn("text", text)
