"""The cached encoder, which the operators outside this subpackage use too."""

from siltstone.functions.bpe import TOKENS, Encoder  # noqa: F401
