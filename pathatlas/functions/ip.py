"""Address arithmetic as Column expressions.

IPv4 addresses are BIGINT, IPv6 addresses BINARY(16) big-endian (unsigned byte order is
numeric order, so sorting, min/max and Parquet statistics work on the column itself).
Bit work happens on a signed pair ``(hi, lo)`` of BIGINT halves; an IPv4 address is the
pair ``(0, ip)``. No expression here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4_BITS, V6_BITS = 32, 128
_MAX64, _MIN64 = 9223372036854775807, -9223372036854775808


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (keeps trees small)."""
    return F.get(F.transform(F.array(value), body), 0)


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def is_wide(df: DataFrame, col: str) -> bool:
    """True when the address column holds 128-bit values."""
    return isinstance(df.schema[col].dataType, T.BinaryType)


def bits_of(wide: bool) -> int:
    return V6_BITS if wide else V4_BITS


# ---- 128-bit halves ---------------------------------------------------------

def _half(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("bigint")


def u128_split(b) -> tuple[Column, Column]:
    """BINARY(16) -> (hi, lo) as two's-complement halves."""
    h = F.hex(_c(b))
    return _half(F.substring(h, 1, 16)), _half(F.substring(h, 17, 16))


def u128_join(hi, lo) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(_c(hi)), 16, "0"), F.lpad(F.hex(_c(lo)), 16, "0")))


def addr_pair(addr, wide: bool) -> tuple[Column, Column]:
    return u128_split(addr) if wide else (_long(0), _c(addr).cast("bigint"))


def addr_from_pair(hi, lo, wide: bool) -> Column:
    return u128_join(hi, lo) if wide else _c(lo)


def as_u128(addr, wide: bool) -> Column:
    """Any address as BINARY(16): one order over both families."""
    return _c(addr) if wide else F.unhex(F.lpad(F.hex(_c(addr).cast("bigint")), 32, "0"))


# ---- masks ------------------------------------------------------------------

def _shl(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n.cast("int"))


def mask_pair(hi: Column, lo: Column, plen, wide: bool) -> tuple[Column, Column]:
    """Clear the host bits of a pair for a prefix length Column."""
    p = _c(plen).cast("int") if not isinstance(plen, int) else F.lit(plen)
    if not wide:
        return hi, F.when(p <= 0, _long(0)).otherwise(lo.bitwiseAND(_shl(_long(-1), F.lit(32) - p)))
    m_hi = F.when(p >= 64, _long(-1)).when(p <= 0, _long(0)).otherwise(_shl(_long(-1), F.lit(64) - p))
    m_lo = F.when(p >= 128, _long(-1)).when(p <= 64, _long(0)).otherwise(_shl(_long(-1), F.lit(128) - p))
    return hi.bitwiseAND(m_hi), lo.bitwiseAND(m_lo)


def host_pair(plen, wide: bool) -> tuple[Column, Column]:
    """The all-ones host part of a prefix length."""
    p = _c(plen).cast("int") if not isinstance(plen, int) else F.lit(plen)
    low = lambda n: F.call_function("shiftrightunsigned", _long(-1), (F.lit(64) - n).cast("int"))
    if not wide:
        return _long(0), F.when(p >= 32, _long(0)).otherwise(low(F.lit(32) - p))
    hi = F.when(p >= 64, _long(0)).when(p <= 0, _long(-1)).otherwise(low(F.lit(64) - p))
    lo = F.when(p >= 128, _long(0)).when(p <= 64, _long(-1)).otherwise(low(F.lit(128) - p))
    return hi, lo


def _pair_struct(addr) -> Column:
    hi, lo = u128_split(addr)
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def network_start(addr, plen, wide: bool) -> Column:
    if wide:
        return let(_pair_struct(addr), lambda p: u128_join(*mask_pair(p["hi"], p["lo"], plen, True)))
    return addr_from_pair(*mask_pair(*addr_pair(addr, wide), plen, wide), wide)


def network_end(addr, plen, wide: bool) -> Column:
    oh, ol = host_pair(plen, wide)

    def last(hi: Column, lo: Column) -> Column:
        hi, lo = mask_pair(hi, lo, plen, wide)
        return addr_from_pair(hi.bitwiseOR(oh), lo.bitwiseOR(ol), wide)

    return let(_pair_struct(addr), lambda p: last(p["hi"], p["lo"])) if wide else last(*addr_pair(addr, wide))


def succ(addr, wide: bool) -> Column:
    """addr + 1; NULL after the last address of the space."""
    a = _c(addr)
    if not wide:
        return a + 1
    up = lambda x: F.when(x == _MAX64, _long(_MIN64)).otherwise(x + 1)
    return let(_pair_struct(a), lambda p: F.when((p["hi"] == -1) & (p["lo"] == -1), F.lit(None).cast("binary"))
               .when(p["lo"] == -1, u128_join(up(p["hi"]), _long(0))).otherwise(u128_join(p["hi"], up(p["lo"]))))


def pred(addr, wide: bool) -> Column:
    """addr - 1; NULL before the first address of the space."""
    a = _c(addr)
    if not wide:
        return a - 1
    down = lambda x: F.when(x == _MIN64, _long(_MAX64)).otherwise(x - 1)
    return let(_pair_struct(a), lambda p: F.when((p["hi"] == 0) & (p["lo"] == 0), F.lit(None).cast("binary"))
               .when(p["lo"] == 0, u128_join(down(p["hi"]), _long(-1))).otherwise(u128_join(p["hi"], down(p["lo"]))))


# ---- text -> address --------------------------------------------------------

def ip4_to_int(s) -> Column:
    """Dotted quad -> BIGINT; NULL when malformed or an octet exceeds 255."""
    t = F.trim(_c(s))
    octets = F.transform(F.split(t, r"\."), lambda x: x.try_cast("bigint"))

    def value(o: Column) -> Column:
        o = [F.get(o, i) for i in range(4)]
        ok = (o[0] <= 255) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255)
        return F.when(ok, ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])

    return F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), let(octets, value))


def int_to_ip4(n) -> Column:
    v = _c(n).cast("bigint")
    byte = lambda k: F.shiftright(v, k).bitwiseAND(_long(255)).cast("string")
    return F.concat_ws(".", F.shiftright(v, 24).cast("string"), byte(16), byte(8), byte(0))


def ip6_to_bin(s) -> Column:
    """IPv6 text -> BINARY(16): at most one '::', eight groups, no embedded IPv4."""
    t = F.trim(_c(s))
    words = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

    def filled(h: Column) -> Column:
        left, right = words(F.get(h, 0)), words(F.get(h, 1))
        return let(F.struct(left.alias("l"), right.alias("r")), lambda w: F.concat(
            w["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(w["l"]) - F.size(w["r"]), F.lit(0))), w["r"]))

    groups = let(F.split(t, "::", -1), lambda h: F.when(F.size(h) == 1, F.split(F.get(h, 0), ":", -1))
                 .when((F.size(h) == 2) & (F.locate(":::", t) == 0), filled(h)))
    packed = let(groups, lambda g: F.when(
        (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$")),
        F.unhex(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))))
    return F.when(t.rlike("^[0-9a-fA-F]*:[0-9a-fA-F:]*$"), packed)


def ip6_text(b) -> Column:
    """BINARY(16) -> canonical compressed lower-case text."""
    h = F.lower(F.hex(_c(b)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(
        F.substring(h, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))

    def shorten(full: Column) -> Column:
        out = F
        for n in range(8, 1, -1):  # the longest run wins, the leftmost one among equals
            pat = r"^(.*?)(?:^|:)0(?::0){%d}(?:$|:)(.*)$" % (n - 1)
            run = r"(^|:)0(:0){%d}(:|$)" % (n - 1)
            out = out.when(full.rlike(run), F.regexp_replace(full, pat, "$1::$2"))
        return out.otherwise(full)

    return let(F.array_join(groups, ":"), shorten)


def addr_text(addr, wide: bool) -> Column:
    return ip6_text(addr) if wide else int_to_ip4(addr)


def _bounds(s, wide: bool) -> Column:
    width = bits_of(wide)
    tail = r"/(\d{1,3})$" if wide else r"/(\d{1,2})$"

    def parts(t: Column) -> Column:
        plen_txt = F.regexp_extract(t, tail, 1)
        return F.struct((ip6_to_bin if wide else ip4_to_int)(F.regexp_replace(t, tail, "")).alias("a"),
                        F.when(plen_txt != "", plen_txt.try_cast("int")).otherwise(F.lit(width)).alias("p"),
                        (plen_txt != "").alias("c"))

    return let(let(F.trim(_c(s)), parts), lambda x: F.when(x["a"].isNotNull() & (x["p"] <= width), F.struct(
        network_start(x["a"], x["p"], wide).alias("start"), network_end(x["a"], x["p"], wide).alias("end"),
        x["p"].alias("plen"), x["c"].alias("is_cidr"))))


def cidr4_bounds(s) -> Column:
    """IPv4 address or CIDR -> STRUCT<start, end, plen, is_cidr>; host bits cleared."""
    return _bounds(s, False)


def cidr6_bounds(s) -> Column:
    """IPv6 address or CIDR -> STRUCT<start, end, plen, is_cidr> with BINARY(16) bounds."""
    return _bounds(s, True)


def cidr_bounds(s) -> Column:
    """Either family -> STRUCT<family, start, end, plen, is_cidr>, bounds as BINARY(16)."""
    v4 = let(cidr4_bounds(s), lambda b: F.when(b.isNotNull(), F.struct(
        F.lit(4).alias("family"), as_u128(b["start"], False).alias("start"), as_u128(b["end"], False).alias("end"),
        b["plen"].alias("plen"), b["is_cidr"].alias("is_cidr"))))
    v6 = let(cidr6_bounds(s), lambda b: F.when(b.isNotNull(), F.struct(
        F.lit(6).alias("family"), b["start"].alias("start"), b["end"].alias("end"), b["plen"].alias("plen"),
        b["is_cidr"].alias("is_cidr"))))
    return F.when(F.coalesce(_c(s), F.lit("")).contains(":"), v6).otherwise(v4)


def prefix_from_bytes(b, plen, wide: bool) -> Column:
    """Packed prefix bytes + length -> STRUCT<start, end, prefix>."""
    size = 16 if wide else 4
    padded = F.rpad(F.hex(_c(b)), size * 2, "0")
    addr = F.unhex(padded) if wide else F.conv(padded, 16, 10).cast("bigint")
    return let(addr, lambda a: let(network_start(a, plen, wide), lambda start: F.struct(
        start.alias("start"), network_end(a, plen, wide).alias("end"),
        F.concat(addr_text(start, wide), F.lit("/"), _c(plen).cast("string")).alias("prefix"))))


def family_of(prefix) -> Column:
    return F.when(_c(prefix).contains(":"), F.lit(6)).otherwise(F.lit(4))


def fam_filter(df: DataFrame, family: str, prefix_col: str = "prefix") -> DataFrame:
    """Keep 'all', '4' or '6'."""
    return df if family == "all" else df.where(family_of(prefix_col) == int(family))


def is_private_ip(s) -> Column:
    """RFC 1918, CGNAT, loopback, link-local, ULA and anything unparsable."""
    t = F.lower(_c(s))
    v6 = (t == "::1") | t.rlike("^(fe8|fe9|fea|feb|fc|fd)")
    p = F.split(t, r"\.")
    nums = [F.get(p, i).try_cast("double") for i in range(4)]
    bad = (F.size(p) != 4)
    for n in nums:
        bad = bad | n.isNull()
    a, b = nums[0], nums[1]
    v4 = (a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
          | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    return (F.when(_c(s).isNull() | (t == ""), F.lit(True))
            .when(t.contains(":"), v6).when(bad, F.lit(True)).otherwise(v4))


def hosts_in_prefix(df: DataFrame, start: str, plen: str, limit: int) -> DataFrame:
    """First ``limit`` usable IPv4 hosts of each prefix, one row per host."""
    size = _shl(_long(1), F.lit(32) - F.col(plen))
    first = F.when(size > 2, F.col(start) + 1).otherwise(F.col(start))
    last = F.when(size > 2, F.col(start) + size - 2).otherwise(F.col(start))
    last = F.least(last, first + (limit - 1))
    return df.withColumn("host_num", F.explode(F.sequence(first, last))).withColumn(
        "host", int_to_ip4("host_num"))


# ---- minimal CIDR cover -----------------------------------------------------

def _bitlen(x: Column) -> Column:
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def _bit(x_hi: Column, x_lo: Column, k: Column) -> Column:
    pick = lambda x, n: F.call_function("shiftrightunsigned", x, n.cast("int")).bitwiseAND(_long(1))
    return F.when(k >= 64, pick(x_hi, k - 64)).otherwise(pick(x_lo, k))


def _trailing(x: Column, digit: str) -> Column:
    b = F.bin(x)
    return F.length(b) - F.length(F.regexp_replace(b, digit + "+$", ""))


def range_to_cidr_blocks(start, end, wide: bool) -> Column:
    """[start, end] -> ARRAY<STRUCT<start, plen>>, the minimal cover in address order.

    Closed form, no loop and no carry: below the highest bit in which both ends differ,
    the blocks on the left follow the zero bits of ``start`` and the blocks on the right
    follow the one bits of ``end``.
    """
    width = bits_of(wide)

    def cover(z: Column) -> Column:
        sh, sl, eh, el, d, tz, to = (z[k] for k in ("sh", "sl", "eh", "el", "d", "tz", "to"))

        def block(hi: Column, lo: Column, k: Column) -> Column:
            return F.struct(addr_from_pair(hi, lo, wide).alias("start"), (F.lit(width) - k).cast("int").alias("plen"))

        def one_at(k: Column) -> tuple[Column, Column]:
            return (F.when(k >= 64, _shl(_long(1), k - 64)).otherwise(_long(0)),
                    F.when(k >= 64, _long(0)).otherwise(_shl(_long(1), k)))

        half = d - 1
        left_k, right_k = F.least(tz, half), F.least(to, half)

        def left_block(k: Column) -> Column:
            bh, bl = one_at(k)
            mh, ml = mask_pair(sh, sl, F.lit(width - 1) - k, wide)
            return block(mh.bitwiseOR(bh), ml.bitwiseOR(bl), k)

        def right_block(k: Column) -> Column:
            return block(*mask_pair(eh, el, F.lit(width - 1) - k, wide), k)

        span = lambda low: F.when(low < half, F.sequence(low + 1, half)).otherwise(F.array(half))
        left = F.transform(F.filter(span(left_k), lambda k: (k > left_k) & (k < half) & (_bit(sh, sl, k) == 0)), left_block)
        right = F.transform(F.filter(F.reverse(span(right_k)), lambda k: (k > right_k) & (k < half) & (_bit(eh, el, k) == 1)), right_block)
        rh, rl = mask_pair(eh, el, F.lit(width) - right_k, wide)
        return F.when((tz >= d) & (to >= d), F.array(block(sh, sl, d))).otherwise(
            F.concat(F.array(block(sh, sl, left_k)), left, right, F.array(block(rh, rl, right_k))))

    def measure(p: Column) -> Column:
        sh, sl, eh, el = p["sh"], p["sl"], p["eh"], p["el"]
        xh, xl = sh.bitwiseXOR(eh), sl.bitwiseXOR(el)
        d = F.when(xh != 0, F.lit(64) + _bitlen(xh)).otherwise(_bitlen(xl))
        tz = F.when(sl != 0, _trailing(sl, "0")).when(sh != 0, F.lit(64) + _trailing(sh, "0")).otherwise(F.lit(width))
        to = F.when(el == -1, F.lit(64) + F.when(eh == -1, F.lit(64)).otherwise(_trailing(eh, "1"))).otherwise(_trailing(el, "1"))
        return F.struct(sh.alias("sh"), sl.alias("sl"), eh.alias("eh"), el.alias("el"), d.alias("d"), tz.alias("tz"), to.alias("to"))

    pairs = F.struct(*[c.alias(n) for n, c in zip(("sh", "sl", "eh", "el"), (*addr_pair(start, wide), *addr_pair(end, wide)))])
    return let(let(pairs, measure), cover)


def range_to_cidrs(start, end, wide: bool) -> Column:
    """[start, end] -> ARRAY<STRING> of CIDR texts."""
    return F.transform(range_to_cidr_blocks(start, end, wide), lambda b: F.concat(
        addr_text(b["start"], wide), F.lit("/"), b["plen"].cast("string")))
