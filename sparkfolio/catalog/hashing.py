"""SQL twin of the hashed embedding: tokens, their 32-bit murmur3 buckets, and unit vectors of texts cut into pieces."""

from __future__ import annotations

from sparkfolio.catalog.q_text import STOPS

_M = 4294967295  # numbers stay below 2**32


def _byte(i: str) -> str:
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(x, CAST({k} AS BIGINT), 1)) - 1)"
    return f"CAST({digit(f'2 * ({i}) - 1')} * 16 + {digit(f'2 * ({i})')} AS UBIGINT)"


def _word(i: str, n: int) -> str:
    return " + ".join(f"{_byte(f'{i} + {k}')} * {256 ** (k - 1)}" for k in range(1, n + 1))


def _turned(x: str, bits: int) -> str:
    return f"((({x}) * {1 << bits}) & {_M}) | (({x}) >> {32 - bits})"


def buckets_sql(tokens: str, dims: int) -> str:
    """SELECT tok, bucket over the distinct ``tok`` of the table ``tokens``."""
    tail = f"CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN {_word('n - 1', 1)} WHEN 2 THEN {_word('n - 2', 2)} ELSE {_word('n - 3', 3)} END"
    both = "xor(h, k)"
    return f"""SELECT tok, CAST(xor(e, e >> 16) % {dims} AS INT) AS bucket FROM (
  SELECT tok, (xor(c, c >> 13) * 3266489909) & {_M} AS e FROM (
  SELECT tok, (xor(b, b >> 16) * 2246822507) & {_M} AS c FROM (
  SELECT tok, xor(xor(list_reduce(list_prepend(CAST(42 AS UBIGINT), ks[1 : len(ks) - 1]), lambda h, k: ((({_turned(both, 13)}) * 5) + 3864292196) & {_M}), ks[len(ks)]), n) AS b FROM (
  SELECT tok, n, list_transform(list_transform(list_transform(list_append(list_transform(range(CAST(n // 4 AS BIGINT)), lambda j: {_word('4 * j', 4)}), CAST({tail} AS UBIGINT)),
      lambda k: (k * 3432918353) & {_M}), lambda k: {_turned('k', 15)}), lambda k: (k * 461845907) & {_M}) AS ks FROM (
  SELECT tok, hex(encode(tok)) AS x, CAST(octet_length(encode(tok)) AS UBIGINT) AS n FROM (SELECT DISTINCT tok FROM {tokens}))))))"""


def vectors_sql(texts: str, dims: int, max_words: int = 1 << 40, name: str = "hv", kind: str = "FLOAT") -> str:
    """CTEs ``<name>`` (tid, vec; tid is the md5 of the text) of the distinct texts of the table ``texts`` (txt) that have tokens: their unit vectors."""
    return rf"""{name}_w AS (SELECT tid, unnest(ws) AS w, (generate_subscripts(ws, 1) - 1) // {max_words} AS p FROM (
     SELECT md5(txt) AS tid, regexp_extract_all(replace(txt, chr(160), ' '), '\S+') AS ws FROM (SELECT DISTINCT txt FROM {texts} WHERE txt IS NOT NULL))),
   {name}_n AS (SELECT tid, p, count(*) AS n FROM {name}_w GROUP BY ALL),
   {name}_t AS (SELECT tid, p, tok, count(*) AS c FROM (SELECT tid, p, unnest(regexp_extract_all(lower(w), '\p{{L}}+')) AS tok FROM {name}_w)
     WHERE length(tok) > 2 AND tok NOT IN ({STOPS}) GROUP BY ALL),
   {name}_h AS ({buckets_sql(f"{name}_t", dims)}),
   {name}_c AS (SELECT tid, p, bucket, sum(c) AS c FROM {name}_t JOIN {name}_h USING (tok) GROUP BY ALL),
   {name}_s AS (SELECT tid, p, sqrt(sum(c * c)) AS size FROM {name}_c GROUP BY ALL),
   {name}_m AS (SELECT tid, bucket, sum(n * c / size) AS m FROM {name}_c JOIN {name}_s USING (tid, p) JOIN {name}_n USING (tid, p) GROUP BY ALL),
   {name}_u AS (SELECT tid, bucket, CAST(m / sqrt(sum(m * m) OVER (PARTITION BY tid)) AS {kind}) AS v FROM {name}_m),
   {name} AS (SELECT tid, list(CAST(coalesce(v, 0) AS DOUBLE) ORDER BY bucket) AS vec FROM (SELECT DISTINCT tid FROM {name}_u) CROSS JOIN
     (SELECT unnest(range({dims})) AS bucket) LEFT JOIN {name}_u USING (tid, bucket) GROUP BY tid)"""
