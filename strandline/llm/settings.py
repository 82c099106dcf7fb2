"""Parameters that the queries and the pipeline share."""

from __future__ import annotations

#: Separator of the flat token files: the identifier that the rank file leaves free.
END_OF_DOCUMENT = 50256
#: Multiplicity of the mixture: a source's share is its row count to this power.
MIX_EXPONENT = 0.5
MIX_SEED = 7


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
