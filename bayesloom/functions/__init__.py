"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from bayesloom.functions.exprs import (  # noqa: F401
    digamma_sql,
    hash_uniform,
    hash_uniform_block,
    hash_uniform_block_sql,
    hash_uniform_sql,
    lgamma,
    lgamma_sql,
    probit,
    probit_sql,
    log2,
    pack_codes,
    round_to,
)
