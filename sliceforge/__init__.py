"""sliceforge: token-bounded document chunking on Spark DataFrames.

Documents in, chunk / document / manifest / run tables out.  Everything is a
DataFrame transformation; the only Python on the hot path is the per-document
greedy packer (an Arrow-batched pandas UDF), see ``operators.chunker``.
"""

from sliceforge.config import MODEL_CONFIGS, ChunkOptions, token_limit

__all__ = ["MODEL_CONFIGS", "ChunkOptions", "token_limit"]
__version__ = "0.1.0"
