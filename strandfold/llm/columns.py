"""Names for helper columns beside a caller's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns of df in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def crc32_sql(value: str) -> str:
    """Unsigned crc32 of a value's decimal or other text in DuckDB, bit by bit (ASCII only); null for null."""
    bits = f"flatten(list_transform(string_split(({value})::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
    return f"(4294967295 - list_reduce({bits}, lambda a, x: {step}, 4294967295::bigint))"
