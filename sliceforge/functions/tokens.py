"""Token counters.

A counter is a Column expression.  For ``regex`` and ``chars`` the JVM counts
everything: the Arrow packer gets the tokens of oversize sentences from it and
only adds them up, so there is one set of Unicode tables.  ``py_counter`` is the
Python form of a counter, for the packer under ``bpe`` and for tests.

* ``regex`` (C2)  words and single punctuation marks; pure Catalyst.
* ``chars``        number of code points; for tests and golden cases.
* ``bpe``   (C1)   byte-pair encoding through tiktoken, Arrow UDFs.
"""

from __future__ import annotations

import base64
import functools
import logging
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceforge.functions.text import WS_CLASS_JAVA, WS_CLASS_PY

log = logging.getLogger(__name__)

# Rule-based tokens: a run of letters / marks / digits / underscore, or one
# character that is neither such a character nor white space.
_WORD = r"\p{L}\p{M}\p{N}_"
TOKEN_PATTERN_JAVA = f"[{_WORD}]+|[^{_WORD}{WS_CLASS_JAVA}]"  # Spark (Java) and DuckDB (RE2)
TOKEN_PATTERN_PY = f"[{_WORD}]+|[^{_WORD}{WS_CLASS_PY}]"  # Python ``regex`` module

# Special-token strings of the local vocabularies.
SPECIAL_TOKENS: dict[str, int] = {"<|endoftext|>": 50256}

# Vocabularies that exist offline, by encoding name -> file in public_tokenizers.
_LOCAL_VOCABS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


@dataclass(frozen=True)
class CounterSpec:
    """Picklable description of a counter; workers rebuild the counter from it."""

    name: str = "regex"
    encoding: str = "byte_bpe_50k"
    on_special: str = "error"  # bpe: error | text
    params: tuple = field(default_factory=tuple)


# --------------------------------------------------------------------------
# Python forms (built once per worker process)
# --------------------------------------------------------------------------


# Fixed value: how text is split before the merges of the rank files.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _rank_file(encoding: str) -> str | None:
    """Rank file of an encoding: a path to one (``....tiktoken``, on every
    worker), or a name that the optional package ``public_tokenizers`` holds."""
    if encoding.endswith(".tiktoken"):
        return encoding
    if encoding in _LOCAL_VOCABS:
        import public_tokenizers

        return public_tokenizers.path(_LOCAL_VOCABS[encoding])
    return None


@functools.lru_cache(maxsize=8)
def _bpe_encoding(encoding: str):
    import tiktoken

    path = _rank_file(encoding)
    if path is None:
        return tiktoken.get_encoding(encoding)  # needs the vocabulary file locally
    with open(path, "rb") as fh:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in fh if line.strip())}
    return tiktoken.Encoding(encoding, pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens=dict(SPECIAL_TOKENS))


@functools.lru_cache(maxsize=8)
def py_counter(spec: CounterSpec):
    """A ``str -> int`` function for the given counter."""
    if spec.name == "regex":
        import regex

        pat = regex.compile(TOKEN_PATTERN_PY)
        return lambda s: len(pat.findall(s))
    if spec.name == "chars":
        return len
    if spec.name == "bpe":
        enc = _bpe_encoding(spec.encoding)
        if spec.on_special == "text":
            return lambda s: len(enc.encode_ordinary(s))
        return lambda s: len(enc.encode(s))
    raise ValueError(f"unknown counter {spec.name!r}")


# --------------------------------------------------------------------------
# Column forms
# --------------------------------------------------------------------------


def regex_count(text: Column) -> Column:
    """Number of rule-based tokens, evaluated in the JVM."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN_JAVA))


def regex_tokens(text: Column) -> Column:
    """The rule-based token strings, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN_JAVA), 0)


def token_id(tok: Column) -> Column:
    """Deterministic id of a token string: its MD5, in full.

    Replaces the salted per-process ``hash`` of the reference (C5), so ids are
    the same in every process and engine; two tokens do not share one.
    """
    return F.md5(tok)


def regex_encode(text: Column) -> Column:
    """Token ids of the rule-based tokenizer (``array<string>``)."""
    return F.transform(regex_tokens(text), token_id)


def regex_decode_ids(ids: Column) -> Column:
    """C6 parity form: the ids joined with a space (what the reference returns)."""
    return F.array_join(ids, " ")


def _safe(count):
    """Null instead of an exception for one text (``on_special="error"`` and a
    special-token string): one bad row must not fail the task."""

    def run(t):
        if t is None:
            return None
        try:
            return count(t)
        except ValueError:
            return None

    return run


#: Rows of a batch that are Python objects at a time; the others stay Arrow data,
#: so a worker's memory does not grow with the rows of a batch.
ROWS_AT_ONCE = 32


def in_slices(kind: pa.DataType, work, *arrays: pa.Array) -> pa.Array:
    """``work`` over the rows of a batch, a few at a time: it takes the values of
    each array and gives the results, one per row (a list, or Arrow data)."""
    parts = []
    for i in range(0, len(arrays[0]), ROWS_AT_ONCE):
        done = work(*(a.slice(i, ROWS_AT_ONCE).to_numpy(zero_copy_only=False) for a in arrays))
        parts.append(done if isinstance(done, pa.Array) else pa.array(done, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _bpe_count_udf(spec: CounterSpec):
    @F.arrow_udf(T.IntegerType())
    def bpe_count(texts: pa.Array) -> pa.Array:
        count = _safe(py_counter(spec))
        return in_slices(pa.int32(), lambda rows: [count(t) for t in rows], texts)

    return bpe_count


def _bpe_count_array_udf(spec: CounterSpec):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def bpe_count_array(arrays: pa.Array) -> pa.Array:
        count = _safe(py_counter(spec))
        return in_slices(pa.list_(pa.int32()), lambda rows: [None if a is None else [count(t) for t in a] for a in rows], arrays)

    return bpe_count_array


def _bpe_encode_udf(spec: CounterSpec):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def bpe_encode(texts: pa.Array) -> pa.Array:
        enc = _bpe_encoding(spec.encoding)
        fn = enc.encode_ordinary if spec.on_special == "text" else enc.encode
        return in_slices(pa.list_(pa.int32()), lambda rows: [None if t is None else fn(t) for t in rows], texts)

    return bpe_encode


def _bpe_decode_udf(spec: CounterSpec):
    @F.arrow_udf(T.StringType())
    def bpe_decode(ids: pa.Array) -> pa.Array:
        enc = _bpe_encoding(spec.encoding)
        return in_slices(pa.string(), lambda rows: [None if x is None else enc.decode(x.tolist()) for x in rows], ids)

    return bpe_decode


class Counter:
    """The counter protocol -- count / encode / decode as Columns."""

    def __init__(self, spec: CounterSpec):
        self.spec = spec

    @property
    def name(self) -> str:
        return self.spec.name

    @property
    def token_pattern(self) -> str:
        """The JVM pattern whose matches are the tokens of the rule counter."""
        return TOKEN_PATTERN_JAVA

    def count(self, text: Column) -> Column:
        if self.spec.name == "regex":
            return regex_count(text)
        if self.spec.name == "chars":
            return F.char_length(text)
        if self.spec.name == "bpe":
            return _bpe_count_udf(self.spec)(text)
        raise ValueError(self.spec.name)

    def count_array(self, texts: Column) -> Column:
        """Count every element of an ``array<string>``."""
        if self.spec.name == "bpe":
            return _bpe_count_array_udf(self.spec)(texts)
        return F.transform(texts, lambda x: self.count(x))

    def encode(self, text: Column) -> Column:
        if self.spec.name == "regex":
            return regex_encode(text)
        if self.spec.name == "bpe":
            return _bpe_encode_udf(self.spec)(text)
        raise ValueError(f"counter {self.spec.name!r} has no encode")

    def decode(self, ids: Column) -> Column:
        if self.spec.name == "regex":
            return regex_decode_ids(ids)
        if self.spec.name == "bpe":
            return _bpe_decode_udf(self.spec)(ids)
        raise ValueError(f"counter {self.spec.name!r} has no decode")

    def special_error(self, text: Column) -> Column:
        """The error a BPE ``encode`` raises on special-token text, else null."""
        if self.spec.name != "bpe" or self.spec.on_special == "text":
            return F.lit(None).cast("string")
        cond = None
        msg = None
        for tok in sorted(_bpe_encoding(self.spec.encoding).special_tokens_set):
            hit = F.instr(text, tok) > 0
            cond = hit if cond is None else (cond | hit)
            m = F.when(hit, F.lit(f"Encountered text corresponding to disallowed special token {tok!r}."))
            msg = m if msg is None else F.coalesce(msg, m)
        return F.when(cond, msg)


COUNTERS = ("regex", "chars", "bpe")


def get_counter(name: str = "regex", **kw) -> Counter:
    if name not in COUNTERS:
        raise ValueError(f"unknown counter {name!r}; choose from {', '.join(COUNTERS)}")
    return Counter(CounterSpec(name=name, **kw))


def resolve_counter(preferred: str = "bpe", encoding: str = "cl100k_base", fallback: str = "regex"):
    """Pick the counter once, on the driver.

    BPE first; if its vocabulary cannot be loaded, fall back to the rule-based
    counter, which (like the reference's fallback) also switches the sentence
    splitter to the lossless one.  Returns ``(counter, splitter, fell_back)``;
    the fallback is logged and reported, never silent.
    """
    if preferred == "bpe":
        try:
            _bpe_encoding(encoding)
            return get_counter("bpe", encoding=encoding), "dot", False
        except Exception as exc:  # no vocabulary offline, bad name, ...
            log.warning("BPE encoding %s unavailable (%s); falling back to %s", encoding, exc, fallback)
            return get_counter(fallback), "lossless", True
    return get_counter(preferred), "dot", False


def vocabulary(texts, text_col: str = "text"):
    """C6 support: the corpus vocabulary ``(id, token)`` of the rule tokenizer.

    ``explode`` + ``distinct``: a shuffle on the token, partially
    de-duplicated map-side.
    """
    toks = texts.select(F.explode(regex_tokens(F.col(text_col))).alias("token")).distinct()
    return toks.select(token_id(F.col("token")).alias("id"), "token")


def decode_with_vocabulary(encoded, vocab, ids_col: str = "ids", key: str = "doc_id", keep: tuple = ()):
    """Ids -> text through the vocabulary table (tokens joined by ' ').

    Only the distinct ids of each slice of documents travel, and of them only those
    that few slices use (see ``operators.vocabulary.translate``); the text is rebuilt
    from each token's place among them.  Documents without tokens decode to the empty
    text; two tokens of one id are an error.  ``keep`` names columns that stay.
    """
    from sliceforge.operators.vocabulary import translate

    def narrow(i):
        # An MD5 in hex as its 16 bytes, any other id with 17 bytes before it.
        other = F.concat(F.lit("-" * 17), i).cast("binary")
        return F.when(F.regexp_like(i, F.lit(r"\A[0-9a-f]{32}\z")), F.unhex(i)).otherwise(other)

    # A token's id is its MD5, so an id with two tokens fails the job.
    one = vocab.groupBy(narrow(F.col("id")).alias("id")).agg(F.min("token").alias("token"), F.count("*").alias("n")).select(
        "id", F.when(F.col("n") == 1, F.col("token")).otherwise(F.raise_error(F.lit("two tokens of one id"))).alias("token")
    )
    tokens = translate(encoded.select(key, *keep, ids_col), ids_col, one, "id", "token", None, narrow)
    return tokens.select(key, *keep, F.coalesce(F.array_join(ids_col, " "), F.lit("")).alias("decoded"))
