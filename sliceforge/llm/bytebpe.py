"""Byte-level BPE vocabularies: file loading and pre-tokens.

The vocabulary path is a parameter everywhere; files are read on the workers
and never copied.  State per Python worker is built once (``load``).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the pre-token pattern that belongs to these vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Here all Unicode versions agree on letters, digits and spaces; a text with
#: other characters is split by the tokenizer library itself.
STABLE = (range(0x500), range(0x2010, 0x2028), range(0x20AC, 0x20AD))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _members(unicode_class: str) -> str:
    """The stable characters of a class, for a bracket of the ``re`` module."""
    member = regex.compile(unicode_class)
    return "".join(re.escape(chr(c)) for part in STABLE for c in part if member.match(chr(c)))


def fast_pattern() -> re.Pattern:
    """PRETOKEN for texts of stable characters, which ``re`` splits in less than
    half the time: classes written out, words (the usual case) tried first."""
    l, n, s = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")  # noqa: E741
    return re.compile(rf" ?[{l}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


def char_classes() -> np.ndarray:
    """Class of each stable character: space 0, letter 1, digit 2, other 3."""
    table = np.full(STABLE[-1][-1] + 1, 3, dtype=np.uint8)
    for value, name in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        member = regex.compile(name)
        for part in STABLE:
            for c in part:
                if member.match(chr(c)):
                    table[c] = value
    return table


def split_texts(texts: list[str], classes: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """PRETOKEN over texts of stable characters, all at once: their pre-tokens, one
    after another, and how many each text has.

    Behind each text stands a character of class 4, so that no token crosses.
    """
    joined = "\0".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    cls = classes[code]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    cls[ends] = 4
    before = np.concatenate((np.full(1, 4, dtype=np.uint8), cls[:-1]))
    behind = np.concatenate((cls[1:], np.full(1, 4, dtype=np.uint8)))
    space, blank = cls == 0, np.concatenate((np.zeros(1, dtype=bool), code[:-1] == ord(" ")))
    # A run begins where the class changes, but behind a blank, which it takes in.
    # Of spaces the last before a run of others begins a token of its own.
    starts = (cls != before) & ~((before == 0) & blank & ~space & (cls != 4))
    starts |= space & (behind > 0) & (behind < 4)
    # Contractions: a lone sign that begins a token, and one or two letters.
    sign = np.flatnonzero(starts & (code == ord("'")) & (behind == 1))
    one = np.isin(code[sign + 1], [ord(c) for c in "stmd"])
    after = code[np.minimum(sign + 2, len(code) - 1)]
    pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
    two = np.logical_or.reduce([(code[sign + 1] == a) & (after == b) for a, b in pairs]) if len(sign) else one
    starts[sign[one | two] + 1] = False
    for at in (sign[one] + 2, sign[two] + 3):
        starts[at[cls[at] == 1]] = True
    starts[ends] = True
    begin = np.flatnonzero(starts)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800)
    place = np.append(np.cumsum(width) - width, int(width.sum()))
    data = pa.py_buffer(joined.encode("utf-8"))
    tokens = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(place[begin], place[-1])), data)
    last = np.searchsorted(begin, ends)  # the characters between texts, which go
    counts = np.diff(np.concatenate(([-1], last))) - 1
    kept = np.ones(len(begin), dtype=bool)
    kept[last] = False
    return tokens.filter(pa.array(kept)), counts


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such files: printable
    Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for i, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges as sorted integer keys, the byte ids and the pre-token splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.letters = letters
        self.size = max(ids.values()) + 1
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_id = keys[order], order.astype(np.int64), merged[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = (
            regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        )
        self.pattern = fast_pattern()
        self.classes = char_classes()
        self.unstable = re.compile("[^" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in STABLE) + "]")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model

    def plain_pretokens(self, text: str) -> list[str]:
        if self.unstable.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pretokens(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens of ``text``, special strings whole among them, and whether
        there are any special strings."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.plain_pretokens(text), False
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += self.plain_pretokens(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain_pretokens(text[at:]), True

    def ids_of(self, pretoken: str) -> list[int]:
        """Ids of one pre-token, by the library's own model."""
        word = "".join(self.letters[b] for b in pretoken.encode("utf-8"))
        return [t.id for t in self.model.tokenize(word)]


    def piece_encoder(self):
        """A function bytes of a pre-token -> ids.

        If merges are ranked in the order of their ids, the file is one of ranks,
        and the rank library's encoder takes the bytes as they are; else the file's
        own model is asked."""
        by_rank = self.pair_id[np.argsort(self.pair_rank)]
        if len(by_rank) and (np.diff(by_rank) > 0).all():
            from tiktoken import Encoding

            byte = {c: bytes([b]) for b, c in enumerate(self.letters)}
            spec = json.loads(self.library.to_str())["model"]["vocab"]
            ranks = {b"".join(byte[c] for c in t): i for t, i in spec.items() if t not in self.special}
            return Encoding("pieces", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda raw: self.ids_of(raw.decode("utf-8"))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
