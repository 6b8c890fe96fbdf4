"""Picture descriptions and positions as EXIF bytes, written and read by column functions. No image is coded.

A payload is ``Exif`` and two zeros, then a little-endian TIFF: a header, a directory of text entries, a directory of the position if there is one, and the values that don't fit into
an entry's four bytes, in order of the entries. All is put together as hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import dms, valid_gps
from .numbers import let

#: Fixed values of the format: tags of the first directory and of the position's, and kinds of values.
DESCRIPTION, SOFTWARE, MADE_AT, POSITION = 0x010E, 0x0131, 0x0132, 0x8825
VERSION, LAT_SIDE, LAT, LON_SIDE, LON, DATUM = 0x0000, 0x0001, 0x0002, 0x0003, 0x0004, 0x0012
BYTE, TEXT, LONG, RATIO = 1, 2, 4, 5
HEADER, ENTRY, MOST = 8, 12, 65535
MARK = "457869660000"


def little(n: Column, size: int) -> Column:
    """A number as so many bytes, lowest first, in hex."""
    return let(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"), lambda digits: F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def number(n: int, size: int) -> str:
    return n.to_bytes(size, "little").hex().upper()


def text_bytes(text: Column) -> Column:
    """ASCII bytes and a zero, in hex; other characters are question marks."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x00-\x7F]", "?")
    return F.concat(F.hex(plain), F.lit("00"))


def ratios(angle: Column) -> Column:
    """Degrees, minutes and seconds as three pairs of numbers, in hex."""
    return F.array_join(F.transform(dms(angle), lambda part: F.concat(little(part["num"], 4), little(part["den"], 4))), "")


def directory(entries: Column, start: Column) -> Column:
    """head and values, in hex: a directory of some entries (tag, kind: in hex; count; value in hex), and those of their values that are kept elsewhere, from offset start on."""
    apart = lambda e: F.when(F.length(e["value"]) > 8, e["value"]).otherwise("")

    def written(e: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(entries, F.lit(1), k), F.lit(0), lambda acc, x: acc + (F.length(apart(x)) / 2).cast("int"))
        return F.concat(e["tag"], e["kind"], little(e["count"], 4), F.when(F.length(e["value"]) <= 8, F.rpad(e["value"], 8, "0")).otherwise(little(start + before, 4)))

    head = F.concat(little(F.size(entries), 2), F.array_join(F.transform(entries, written), ""), F.lit(number(0, 4)))
    return F.struct(head.alias("head"), F.array_join(F.transform(entries, apart), "").alias("values"))


def entry(tag: int, kind: int, value: Column, each: int) -> Column:
    """each: bytes of one of the values that are counted."""
    count = (F.length(value) / (2 * each)).cast("int")
    return F.struct(F.lit(number(tag, 2)).alias("tag"), F.lit(number(kind, 2)).alias("kind"), count.alias("count"), value.alias("value"))


def exif(description: Column, software: Column, made_at: Column, lat: Column, lon: Column, versioned: bool = False) -> Column:
    """The payload, binary. Positions that are missing, not finite or off the globe are left out; ``versioned`` puts the version before the position's other entries."""
    texts = F.array(*[entry(tag, TEXT, text_bytes(x), 1) for tag, x in ((DESCRIPTION, description), (SOFTWARE, software), (MADE_AT, made_at))])
    side = lambda x, plus, minus: F.when(x >= 0, plus.encode().hex().upper() + "00").otherwise(minus.encode().hex().upper() + "00")
    place = [entry(VERSION, BYTE, F.lit("02030000"), 1)] if versioned else []
    place += [entry(LAT_SIDE, TEXT, side(lat, "N", "S"), 1), entry(LAT, RATIO, ratios(lat), 8), entry(LON_SIDE, TEXT, side(lon, "E", "W"), 1), entry(LON, RATIO, ratios(lon), 8)]
    place = F.array(*place, entry(DATUM, TEXT, F.lit(b"WGS-84\0".hex().upper()), 1))
    lead = MARK + "49492A00" + number(HEADER, 4)
    long = lambda n: HEADER + 2 + n * ENTRY + 4
    second = long(4)
    start = second + 2 + (6 if versioned else 5) * ENTRY + 4
    pointer = F.array(entry(POSITION, LONG, F.lit(number(second, 4)), 4))

    def with_place(one: Column) -> Column:
        more = directory(place, F.lit(start) + (F.length(one["values"]) / 2).cast("int"))
        return let(more, lambda two: F.unhex(F.concat(F.lit(lead), one["head"], two["head"], one["values"], two["values"])))

    bare = let(directory(texts, F.lit(long(3))), lambda one: F.unhex(F.concat(F.lit(lead), one["head"], one["values"])))
    return F.when(valid_gps(lat, lon), let(directory(F.concat(texts, pointer), F.lit(start)), with_place)).otherwise(bare)


def insert(image: Column, payload: Column) -> Column:
    """A JPEG with the payload right after its start marker; other bytes, and payloads beyond a segment's size, change nothing."""
    size = F.length(payload) + 2
    whole = F.unhex(F.concat(F.lit("FFD8FFE1"), F.lpad(F.hex(size.cast("bigint")), 4, "0"), F.hex(payload), F.substring(F.hex(image), 5, 1 << 30)))
    return F.when(F.hex(F.substring(image, 1, 2)).eqNullSafe("FFD8") & (size <= MOST), whole).otherwise(image)


def read_number(raw: Column, at: Column, size: int) -> Column:
    """The little-endian number at a byte of some hex digits."""
    return let(raw.substr(2 * at + 1, F.lit(2 * size)), lambda digits: F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("bigint"))


def entries_of(raw: Column, at: Column) -> Column:
    """tag, count and the place of the value of each entry of the directory at a byte of the TIFF's hex digits."""

    def found(x: Column) -> Column:
        size = x["count"] * F.when(x["kind"] == RATIO, 8).when(x["kind"] == LONG, 4).otherwise(1)
        return F.struct(x["tag"].alias("tag"), x["count"].alias("count"), F.when(size <= 4, x["begin"] + 8).otherwise(x["far"]).cast("int").alias("at"))

    def read_one(begin: Column) -> Column:
        fields = {"tag": (0, 2), "kind": (2, 2), "count": (4, 4), "far": (8, 4)}
        return let(F.struct(begin.alias("begin"), *[read_number(raw, begin + k, n).alias(name) for name, (k, n) in fields.items()]), found)

    def read_all(count: Column) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: let(at + 2 + k * ENTRY, read_one)))

    return let(read_number(raw, at, 2).cast("int"), read_all)


def read_exif(image: Column) -> Column:
    """description, software, made_at, lat, lon of a JPEG whose first segment is EXIF: the directories are walked back from the header. Null without such a segment."""
    found = lambda entries, tag: F.get(F.filter(entries, lambda e: e["tag"] == tag), F.lit(0))

    def facts(tiff: Column) -> Column:
        def text(entries: Column, tag: int) -> Column:
            return let(found(entries, tag), lambda e: F.decode(F.unhex(tiff.substr(2 * e["at"] + 1, (2 * (e["count"] - 1)).cast("int"))), "US-ASCII"))

        def angle(entries: Column, tag: int, side: int, minus: str) -> Column:
            part = lambda at, k: read_number(tiff, at + 8 * k, 4) / read_number(tiff, at + 8 * k + 4, 4)
            size = let(found(entries, tag)["at"], lambda at: part(at, 0) + part(at, 1) / 60 + part(at, 2) / 3600)
            return F.when(text(entries, side) == minus, -size).otherwise(size)

        def both(first: Column) -> Column:
            place = let(found(first, POSITION)["at"], lambda at: F.when(at.isNotNull(), let(read_number(tiff, at, 4).cast("int"), lambda second: entries_of(tiff, second))))
            texts = [text(first, tag).alias(name) for tag, name in ((DESCRIPTION, "description"), (SOFTWARE, "software"), (MADE_AT, "made_at"))]
            return let(place, lambda p: F.struct(*texts, angle(p, LAT, LAT_SIDE, "S").alias("lat"), angle(p, LON, LON_SIDE, "W").alias("lon")))

        return let(entries_of(tiff, F.lit(HEADER)), both)

    def checked(raw: Column) -> Column:
        fits = raw.startswith("FFD8FFE1") & (F.substring(raw, 13, 12) == MARK) & (F.substring(raw, 25, 16) == "49492A00" + number(HEADER, 4))
        return F.when(fits, let(F.substring(raw, 25, 1 << 30), facts))

    return let(F.hex(image), checked)
