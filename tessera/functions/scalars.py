"""Column functions for diagnostic records. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is named there; Spark repeats it where a lambda or a condition holds it."""
    return F.get(F.transform(F.array(value), use), 0)


def hex_address(value: Column) -> Column:
    """A 64-bit value as 0x-prefixed lower-case hex; negative longs show their unsigned form."""
    return F.lower(F.concat(F.lit("0x"), F.hex(value)))


def unsigned(value: Column) -> Column:
    """A signed long read as unsigned, as decimal(20,0)."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def parse_address(text: Column) -> Column:
    """Decimal text of an address given in decimal, 0x-hex, or hex with a letter; null if none of these."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike(r"^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10))
        .when(t.rlike(r"^[0-9]{1,20}$"), F.regexp_replace(t, r"^0+(?=.)", ""))
        .when(t.rlike(r"^[0-9a-f]{1,16}$"), F.conv(t, 16, 10))
    )


def masked(value: Column, low_bits: int) -> Column:
    """The value with its low bits cleared."""
    return value.bitwiseAND(F.lit(-1 << low_bits))


def size_text(size: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.concat(F.format_string("%.2f", size / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", size / float(1 << 20)), F.lit(" MB")))
    )


def growth_status(before: Column, now: Column) -> Column:
    """new, removed, increased, decreased or unchanged; null counts as absent."""
    return (
        F.when(before.isNull() & now.isNotNull(), "new")
        .when(now.isNull() & before.isNotNull(), "removed")
        .when(now > before, "increased")
        .when(now < before, "decreased")
        .otherwise("unchanged")
    )


def growth_text(before: Column, now: Column) -> Column:
    """Signed growth in percent, or "new" where nothing was there before."""
    return F.when(before == 0, F.when(now == 0, "0.0%").otherwise("new")).otherwise(
        F.format_string("%+.1f%%", (now - before) * 100.0 / before)
    )


def occurrence_weight(n: Column) -> Column:
    return F.lit(1.0) + F.log(F.greatest(F.lit(1), n).cast("double"))


def package_version_removed(name: Column) -> Column:
    """Versions after an at sign or between slashes are dropped, so that releases of a package agree."""
    return F.regexp_replace(name, r"@\d+(?:\.\d+)*(?:-[\w.]+)?(?=/|$)", "")


def trailing_digits_masked(name: Column) -> Column:
    return F.regexp_replace(name, r"\d+$", "xxx")


def process_short_name(name: Column) -> Column:
    """The last 15 characters of a package name, the first 15 of others."""
    return F.when(name.startswith("com"), F.right(name, F.lit(15))).otherwise(F.left(name, F.lit(15)))


def compact_name(name: Column) -> Column:
    """Lower case, letters and digits only: for weak matches."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def kilobytes(value: Column, unit: Column) -> Column:
    u = F.upper(unit)
    return F.when(u == "GB", value * 1048576).when(u == "MB", value * 1024).when(u == "B", F.expr("0") + value / 1024).otherwise(value)


def column_label(number: Column) -> Column:
    """A, B, ..., Z, AA, ...: bijective base 26 of a number from 1, up to three letters."""

    def letter(v: Column) -> Column:
        return F.chr(65 + v)

    one, two = number - 1, F.floor((number - 1) / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(
        F.when(three >= 0, letter(F.pmod(three, F.lit(26)))).otherwise(""),
        F.when(two >= 0, letter(F.pmod(two, F.lit(26)))).otherwise(""),
        letter(F.pmod(one, F.lit(26))),
    )


def html_escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def chain_text(frames: Column) -> Column:
    """Frames from the root to the leaf, given leaf first."""
    return F.array_join(F.reverse(frames), " -> ")


def chain_depth(trace: Column) -> Column:
    return F.size(F.split(trace, " <- "))


# Layouts of timestamps in logs.
TIME_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd-HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
    "yyyyMMddHHmmss", "yyyyMMddHHmmssSSS", "yyyy-MM-dd-HH-mm-ss", "yyyy-MM-dd'T'HH:mm:ss", "MM-dd-yyyy HH:mm:ss",
)


def parse_time(text: Column, layouts: Sequence[str] = TIME_LAYOUTS) -> Column:
    """The first layout that fits the whole text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in layouts]).cast("timestamp_ntz")


def name_time(name: Column) -> Column:
    """The time in a file name: 14 to 17 digits of a date, or 13 digits of epoch milliseconds."""
    date, epoch = F.regexp_extract(name, r"(?<!\d)(20\d{12})(\d{0,3})(?!\d)", 1), F.regexp_extract(name, r"(?<!\d)(1\d{12})(?!\d)", 1)
    return F.when(date != "", F.try_to_timestamp(date, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")).when(
        epoch != "", F.timestamp_millis(epoch.try_cast("long")).cast("timestamp_ntz")
    )


def registers(text: Column) -> Column:
    """``name:hex`` pairs as a map; of repeated names the last counts."""
    pattern = r"\b([a-z]{1,3}[0-9]{0,2}):([0-9a-f]{8,16})\b"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v")
    )
    last = F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    return last


def address_is_text(address_hex: Column) -> Column:
    """Whether all bytes of a 64-bit hex address are printable ASCII: a pointer overwritten by text."""
    return F.lpad(F.regexp_replace(F.lower(address_hex), "^0x", ""), 16, "0").rlike("^(?:[2-6][0-9a-f]|7[0-9a-e]){8}$")


# Leading bytes, in hex, of media formats.
MAGIC = (
    ("66747970", 5, "mp4"), ("1A45DFA3", 1, "matroska"), ("4F676753", 1, "ogg"), ("664C6143", 1, "flac"), ("52494646", 1, "riff"),
    ("2321414D52", 1, "amr"), ("494433", 1, "mp3"), ("FFFB", 1, "mp3"), ("FFFA", 1, "mp3"), ("FFF3", 1, "mp3"), ("FFF2", 1, "mp3"),
    ("FFF1", 1, "adts"), ("FFF9", 1, "adts"), ("47", 1, "ts"),
)


def media_format(head: Column) -> Column:
    """The format that a file's leading bytes name, or "unknown"."""
    found = F.lit(None).cast("string")
    for magic, at, name in reversed(MAGIC):
        found = F.when(F.hex(F.substring(head, at, len(magic) // 2)) == magic, name).otherwise(found)
    return F.coalesce(found, F.lit("unknown"))


# Words without meaning for search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "what", "with",
)


def latin_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores that start with a letter, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_]*"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def mixed_tokens(text: Column) -> Column:
    """Distinct Latin words, then distinct runs of two or more CJK characters."""
    cjk = F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(latin_tokens(text), cjk))


def has_word(text: Column, word: str) -> Column:
    """Whether a word stands between non-letters; a word beyond ASCII matches anywhere."""
    if not word.isascii():
        return text.contains(word)
    return text.rlike(rf"(?i)(?<![a-z0-9_])\Q{word}\E(?![a-z0-9_])")
