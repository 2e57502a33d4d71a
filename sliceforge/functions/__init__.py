"""Column functions: text scalars, token counters, sentence splitters."""

from sliceforge.functions import sentences, text, tokens

__all__ = ["sentences", "text", "tokens"]
