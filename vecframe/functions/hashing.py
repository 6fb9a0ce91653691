"""Vector and id hashes, and what assigns them to clusters.

No function of Spark gives the bits of a float, and ANSI mode raises on
overflow, so bits come from exact arithmetic and 64-bit hashes are carried as
two halves of 32 bits.  A 64-bit result is DECIMAL(20,0), unsigned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the FNV hashes.
FNV32_START, FNV32_PRIME = 2166136261, 16777619
FNV64_START, FNV64_PRIME = 14695981039346656037, 1099511628211
MASK = 0xFFFFFFFF


def float_bits(x: Column) -> Column:
    """The IEEE bits of a float as BIGINT (unsigned)."""
    d = x.cast("double")
    a = F.abs(d)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(two(guess) > a, guess - 1).when(two(guess + 1) <= a, guess + 1).otherwise(guess)
    normal = (e + 127).cast("bigint") * F.lit(1 << 23) + ((a / two(e) - 1.0) * float(1 << 23)).cast("bigint")
    tiny = (a * F.lit(2.0**149)).cast("bigint")
    size = F.when(a == 0, F.lit(0).cast("bigint")).when(e < -126, tiny).otherwise(normal)
    negative = (d < 0) | ((d == 0) & d.cast("string").startswith("-"))
    return size + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0)).cast("bigint")


def float_bytes(v: Column) -> Column:
    """Little-endian bytes of an array of floats, as array<bigint>."""
    byte = lambda b, s: F.shiftright(b, s).bitwiseAND(F.lit(255).cast("bigint"))
    # the bits are worked out once a number: the second transform has them as its variable
    return F.flatten(F.transform(F.transform(v, float_bits), lambda b: F.array(*(byte(b, s) for s in (0, 8, 16, 24)))))


def text_bytes(s: Column) -> Column:
    """UTF-8 bytes of a string, as array<bigint>."""
    h = F.hex(F.encode(s, "UTF-8"))
    return F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a32(data: Column) -> Column:
    """Of array<bigint> bytes, as BIGINT."""
    return F.aggregate(data, F.lit(FNV32_START).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(MASK).cast("bigint")))


def _times64(hi: Column, lo: Column) -> Column:
    """(hi, lo) times the FNV prime 2**40 + 435, modulo 2**64."""
    p = lo * 435
    mask = F.lit(MASK).cast("bigint")
    return F.struct((hi * 435 + lo * 256 + F.shiftright(p, 32)).bitwiseAND(mask).alias("hi"), p.bitwiseAND(mask).alias("lo"))


def _fnv64(data: Column, xor_first: bool) -> Column:
    start = F.struct(F.lit(FNV64_START >> 32).cast("bigint").alias("hi"), F.lit(FNV64_START & MASK).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        if xor_first:
            return _times64(h.hi, h.lo.bitwiseXOR(b))
        m = _times64(h.hi, h.lo)
        return F.struct(m.hi.alias("hi"), m.lo.bitwiseXOR(b).alias("lo"))

    whole = lambda h: h.hi.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h.lo.cast("decimal(20,0)")
    return F.aggregate(data, start, step, lambda h: whole(h).cast("decimal(20,0)"))


def seeded(data: Column, seed: int | None) -> Column:
    """The bytes after those of a little-endian 64-bit seed."""
    if seed is None:
        return data
    return F.concat(F.array(*(F.lit(b).cast("bigint") for b in (seed % (1 << 64)).to_bytes(8, "little"))), data)


def fnv1a64(data: Column, seed: int | None = None) -> Column:
    return _fnv64(seeded(data, seed), True)


def fnv1_64(data: Column, seed: int | None = None) -> Column:
    return _fnv64(seeded(data, seed), False)


#: Names that the reference accepts; all but fnv1 mean FNV-1a.
HASHERS = {n: fnv1a64 for n in ("fnv1a", "fnv", "xxhash", "md5", "sha1", "sha256")} | {"fnv1": fnv1_64}


def sha1_fold(id_: Column, v: Column, n: int) -> Column:
    """Fold of the hex SHA-1 of the id and the big-endian floats: sum of code << (place mod 32), modulo 2**32, then n."""
    big = F.concat_ws("", F.transform(v, lambda x: F.lpad(F.hex(float_bits(x)), 8, "0")))
    digest = F.sha1(F.concat(F.encode(id_, "UTF-8"), F.unhex(big)))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(0).cast("bigint"), lambda a, i: (a + F.ascii(F.substring(digest, i + 1, F.lit(1))).cast("bigint") * F.pow(F.lit(2.0), i % 32).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint")))
    return total % n


def cluster_of_vector(v: Column, clusters: int) -> Column:
    """The canonical assignment: FNV-1a 32 of the vector's bytes, modulo the clusters."""
    return fnv1a32(float_bytes(v)) % clusters


def cluster_of_id(id_: Column, clusters: int) -> Column:
    return fnv1a32(text_bytes(id_)) % clusters if clusters else F.lit(0).cast("bigint")


def assign(hash64: Column, clusters: int, strategy: str = "hash") -> Column:
    """hash, modulo, consistent: h % n; range: h / ((2**64 - 1) / n), at most n - 1."""
    if strategy in ("hash", "modulo", "consistent"):
        return (hash64 % F.lit(clusters).cast("decimal(20,0)")).cast("bigint")
    if strategy == "range":
        width = ((1 << 64) - 1) // clusters
        return F.least(F.floor(hash64.cast("decimal(38,0)") / F.lit(width).cast("decimal(20,0)")).cast("bigint"), F.lit(clusters - 1).cast("bigint"))
    raise ValueError(f"unknown strategy: {strategy}")
