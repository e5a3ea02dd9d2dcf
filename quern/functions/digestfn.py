"""Digests, canonical encodings, sizes, times, paths and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digest names with their Spark function and hex length.
HASHES = {"sha256": (lambda c: F.sha2(c, 256), 64), "sha512": (lambda c: F.sha2(c, 512), 128), "sha1": (F.sha1, 40), "md5": (F.md5, 32)}


def digest(value: Column, name: str = "sha256") -> Column:
    """'name:hex' of a string or binary column."""
    return F.concat(F.lit(name + ":"), HASHES[name][0](value))


def digest_name(d: Column) -> Column:
    return F.when(d.contains(":"), F.split_part(d, F.lit(":"), F.lit(1))).otherwise("")


def digest_hex(d: Column) -> Column:
    return F.when(d.contains(":"), F.split_part(d, F.lit(":"), F.lit(2))).otherwise("")


def digest_short(d: Column, n: int = 4) -> Column:
    """The hex of the first n bytes."""
    return F.substring(digest_hex(d), 1, 2 * n)


def parse_digest(s: Column) -> Column:
    """'name:hex' in lower case; '' for an empty string; an error for an unknown name or a wrong length.

    Hex may be shorter than the hash (an abbreviation), but in whole bytes.
    """
    name, hex_ = F.split_part(s, F.lit(":"), F.lit(1)), F.lower(F.split_part(s, F.lit(":"), F.lit(2)))
    good = F.lit(False)
    for n, (_, size) in HASHES.items():
        good |= (name == n) & (F.length(hex_) <= size)
    good &= s.contains(":") & hex_.rlike("^([0-9a-f]{2})*$")
    zero = (s == "") | hex_.rlike("^0+$") & good
    return F.when(zero, F.lit("")).when(good, F.concat(name, F.lit(":"), hex_)).otherwise(F.raise_error(F.concat(F.lit("invalid digest: "), s)))


def digest_truncate(d: Column, n: int) -> Column:
    """The first n bytes, the others zero."""
    h = digest_hex(d)
    return F.concat(digest_name(d), F.lit(":"), F.rpad(F.substring(h, 1, 2 * n), F.length(h), "0"))


def digest_is_short(d: Column) -> Column:
    """Whether all but the first 4 bytes are zero."""
    h = digest_hex(d)
    return F.substring(h, 9, 1 << 20).rlike("^0*$") & (F.length(h) > 8)


def digest_abbreviation(d: Column) -> Column:
    """Bytes up to the last that isn't zero."""
    return F.ceil(F.length(F.regexp_replace(digest_hex(d), "0+$", "")) / 2).cast("int")


def digest_expands(long: Column, short: Column) -> Column:
    """Whether ``long`` begins with the bytes of the abbreviation ``short``, both of one hash."""
    return (digest_name(long) == digest_name(short)) & F.startswith(digest_hex(long), F.substring(digest_hex(short), F.lit(1), digest_abbreviation(short) * 2))


def digest_less(a: Column, b: Column) -> Column:
    return F.when(digest_name(a) != digest_name(b), digest_name(a) < digest_name(b)).otherwise(digest_hex(a) < digest_hex(b))


def mix_digests(d: Column, name: str = "sha256") -> Column:
    """Aggregate: XOR of digests of one hash; the empty (zero) digest changes nothing.

    Associative and commutative over fixed-width words, so it combines partially.
    """
    words = [F.bit_xor(F.conv(F.substring(digest_hex(d), 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(HASHES[name][1] // 8)]
    hexes = [F.lpad(F.lower(F.hex(F.coalesce(w, F.lit(0).cast("long")))), 8, "0") for w in words]
    return F.concat(F.lit(name + ":"), *hexes)


def digest_of_digests(sorted_digests: Column, name: str = "sha256") -> Column:
    """Hash over the bytes of an ordered array of digests."""
    return digest(F.unhex(F.array_join(F.transform(sorted_digests, digest_hex), "")), name)


# -- canonical little-endian encodings ---------------------------------------


def little_endian(v: Column, size: int) -> Column:
    """The low ``size`` bytes of a whole number, lowest first."""
    h = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(size))))


def encode_bool(v: Column) -> Column:
    return F.when(v, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))


def encode_string(v: Column) -> Column:
    return F.encode(v, "UTF-8")


def canonical_hash(*parts: Column, name: str = "sha256") -> Column:
    """Digest of encoded parts, one after another."""
    return digest(F.concat(*parts), name)


# -- sizes and times ---------------------------------------------------------

# Binary units.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def format_size(n: Column, largest: str = UNITS[-1]) -> Column:
    """'512B', '1.5KiB' and so on up to the unit ``largest``, one decimal from KiB on, ties to even."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for k in range(1, UNITS.index(largest) + 1):
        out = F.when(F.abs(n) >= 1 << (10 * k), F.concat(F.format_string("%.1f", F.bround(n / float(1 << (10 * k)), 1)), F.lit(UNITS[k]))).otherwise(out)
    return out


def size_count(n: Column, unit: str) -> Column:
    return n / float(1 << (10 * UNITS.index(unit)))


WEEK_MS = 7 * 24 * 3600 * 1000


def coarse_time(ms: Column) -> Column:
    """Start of the epoch-aligned week, towards zero; milliseconds."""
    return ms - F.try_mod(ms, F.lit(WEEK_MS))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


# -- paths -------------------------------------------------------------------

# File types by what follows the last dot; record files have a family name and a dash first.
SUFFIX_TYPES = {"gz": "gzip", "bz2": "bzip2", "zst": "zstd", "json": "json"}
RECORD_TYPES = {"rio": "record", "rpk": "record-packed", "rpk-kd": "record-packed-encrypted", "rpk-gz": "record-packed-compressed", "rpk-gz-kd": "record-packed-compressed-encrypted"}


def path_scheme(p: Column) -> Column:
    return F.regexp_extract(p, r"^([A-Za-z0-9_]+)://", 1)


def path_rest(p: Column) -> Column:
    """What follows the scheme."""
    return F.regexp_replace(p, r"^[A-Za-z0-9_]+://", "")


def path_base(p: Column) -> Column:
    """The last element; '/' for a root, the whole where there is no slash."""
    cut = F.regexp_replace(path_rest(p), "/+$", "")
    return F.when((cut == "") & (path_scheme(p) != ""), p).when(cut == "", F.lit("/")).otherwise(F.regexp_extract(cut, "[^/]*$", 0))


def path_dir(p: Column) -> Column:
    """All but the last element, without a slash at the end unless it is a root."""
    scheme = F.regexp_extract(p, r"^([A-Za-z0-9_]+://)?", 0)
    rest = path_rest(p)
    cut = F.regexp_replace(F.regexp_replace(rest, "[^/]*$", ""), "(?<=.)/+$", "")
    return F.concat(scheme, F.when((cut == "") & (scheme == "") & ~rest.startswith("/"), F.lit(".")).otherwise(cut))


def path_join(*parts: Column) -> Column:
    """Elements with single slashes between; empty ones don't count; the first keeps its scheme."""
    out = parts[0]
    for p in parts[1:]:
        tail = F.regexp_replace(p, "^/+", "")
        out = F.when(p == "", out).when(out == "", p).otherwise(F.concat(F.regexp_replace(out, "(?<=[^/:])/+$", ""), F.when(F.endswith(out, F.lit("://")), F.lit("")).otherwise(F.lit("/")), tail))
    return out


def path_is_absolute(p: Column) -> Column:
    return (path_scheme(p) != "") | p.startswith("/")


def bucket_and_key(url: Column) -> Column:
    """scheme, bucket, key of 'scheme://bucket/key'."""
    get = lambda i: F.regexp_extract(url, r"^([A-Za-z0-9_]+)://([^/]*)/?(.*)$", i)
    return F.struct(get(1).alias("scheme"), get(2).alias("bucket"), get(3).alias("key"))


def file_type(p: Column) -> Column:
    """Type by suffix; 'other' else."""
    suffix = F.regexp_extract(p, r"\.([^.]*)$", 1)
    record = F.regexp_extract(suffix, r"^[a-z]+-(r[a-z-]+)$", 1)
    table = F.create_map(*(F.lit(x) for kv in SUFFIX_TYPES.items() for x in kv))
    records = F.create_map(*(F.lit(x) for kv in RECORD_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, suffix), F.try_element_at(records, record), F.lit("other"))


def spell_correct_store(p: Column) -> Column:
    """'s3:x', 's3:/x', 's3:///x', 's:/x' and 's3//x' as 's3://x'; other paths as they are."""
    fine = (p == "s3://") | p.rlike("^s3://[^/]")
    return F.when(fine, p).otherwise(F.regexp_replace(p, "^(s3?:/*|s3/+)", "s3://"))
