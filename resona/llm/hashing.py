"""Words as 64-bit hashes: `resona.functions.hashing`, by its name in this package."""

from resona.functions.hashing import LONG, SLICE, SPACE, U, byte_values, column_bytes, in_one_document, mix, powers, separators, slices, window_hashes, word_hashes, word_spans  # noqa: F401
