"""Scalar functions with the semantics that feeds and transcripts need, as column expressions.

All are built-in expressions, so they stay inside whole-stage code generation. Nulls give null
unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- missing values


def present(c: Column) -> Column:
    """A text, null where empty."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[present(c) for c in columns])


def first_nonzero(*columns: Column) -> Column:
    """The first number that is neither null, zero nor not a number."""
    return F.coalesce(*[F.when((c != 0) & ~F.isnan(c.cast("double")), c) for c in columns])


# ---- numbers


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def clamp(x: Column, low: object, high: object) -> Column:
    """``x`` within bounds; null for null, unlike greatest() and least()."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def leading_int(text: Column) -> Column:
    """The whole number at a text's beginning, null if there is none or it is beyond 64 bits."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def leading_number(text: Column) -> Column:
    """The decimal number at a text's beginning ("12.5x" is 12.5), null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many decimals."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def fit_inside(width: Column, height: Column, max_width: Column, max_height: Column) -> tuple[Column, Column]:
    """The size of a picture scaled to fit a box, never enlarged; a null bound of the box is no bound."""
    scale = F.least(F.lit(1.0), F.coalesce(max_width / width, F.lit(1.0)), F.coalesce(max_height / height, F.lit(1.0)))
    return half_up(width * scale), half_up(height * scale)


# ---- texts


def ellipsize(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last of them an ellipsis if anything was cut."""
    return F.when(F.char_length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(size - 1)), F.lit("…")))


def cut(text: Column, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters, followed by ``mark`` if anything was cut."""
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(mark))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def first_part(identifier: Column) -> Column:
    """An identifier up to its first dash."""
    return F.substring_index(identifier, "-", 1)


def utf16_length(text: Column) -> Column:
    """Length in 16-bit units, where signs beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def query_value(text: Column) -> Column:
    """Encoded as the value of a query string: %20 for a blank, and letters, digits and ``-_.!~*'()`` as they are."""
    plain = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), plain.items(), F.url_encode(text))


def base64_line(data: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(data), "\r\n", "")


def line_of(name: Column, text: Column) -> Column:
    """``[Name] text``."""
    return F.concat(F.lit("["), name, F.lit("] "), text)


# ---- times


def clock_ms(text: Column) -> Column:
    """Milliseconds of a time written as seconds ("12.5", "12,5", " 3.1s") or as a clock ("1:02:03.5"); null if unreadable.

    A plain number, which most times are, is cast at once; only other texts go through patterns.
    """

    def ms(number: Column) -> Column:
        seconds = number.try_cast("double")
        # Beyond 2**53 a number of milliseconds isn't whole any more.
        return F.when(F.abs(seconds) < 2**53 / 1000, F.floor(seconds * 1000 + 0.5).cast("bigint"))

    # One small expression for the rest: generated code that grows too large isn't compiled.
    bare = F.regexp_extract(F.translate(text, ",", "."), r"^\s*((?:\d+:){0,2}\d+(?:\.\d*)?|-\d+(?:\.\d*)?)\s*s?\s*$", 1)
    folded = F.aggregate(F.split(bare, ":"), F.lit(0.0), lambda total, part: total * 60 + part.try_cast("double"))
    return F.coalesce(ms(text), F.when(F.abs(folded) < 2**53 / 1000, F.floor(folded * 1000 + 0.5).cast("bigint")))


def minutes_label(seconds: Column) -> Column:
    """``m:ss`` with unbounded minutes."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat((F.expr("1") * F.floor(whole / 60)).cast("bigint").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def plain_duration(text: Column) -> Column:
    """Seconds of "90", "1:30" or "1:02:03"; null for anything else, also for "12.5"."""
    parts = F.split(text, ":")
    n = F.size(parts)
    p = [leading_int(F.try_element_at(parts, F.lit(i))) for i in (1, 2, 3)]
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).when(n == 3, p[0] * 3600 + p[1] * 60 + p[2]).when(n == 2, p[0] * 60 + p[1])


def feed_date(text: Column) -> Column:
    """A feed's date (RFC 822 with or without the weekday, or ISO 8601) as an instant; null if unreadable."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    patterns = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in patterns])


# ---- addresses

# Extensions that an address may have, and the extensions of content types.
AUDIO_EXTENSIONS = ["mp3", "m4a", "wav", "ogg", "aac", "flac"]
AUDIO_TYPES = {"audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/mp4": "m4a", "audio/x-m4a": "m4a", "audio/wav": "wav", "audio/ogg": "ogg", "audio/aac": "aac", "audio/flac": "flac"}
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "svg"]
IMAGE_TYPES = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}
# Content types of pictures' extensions.
IMAGE_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit("")))


def file_extension(url: Column, content_type: Column, kind: str = "audio") -> Column:
    """The extension of the file at an address: its path's if that is a known one, else by content type, else mp3 or jpg.

    An address that can't be read counts as one without an extension.
    """
    known, types, default = (AUDIO_EXTENSIONS, AUDIO_TYPES, "mp3") if kind == "audio" else (IMAGE_EXTENSIONS, IMAGE_TYPES, "jpg")
    last = F.lower(F.substring_index(F.try_parse_url(url, F.lit("PATH")), ".", -1))
    own = F.when(last == "jpeg", F.lit("jpg")).when(last.isin(known), last)
    return F.coalesce(own if kind == "image" else F.when(last.isin(known), last), _lookup(types, content_type), F.lit(default))


def image_mime(extension: Column) -> Column:
    """The content type of a picture's extension, JPEG for an unknown one."""
    return F.coalesce(_lookup(IMAGE_MIME, F.lower(extension)), F.lit("image/jpeg"))


def image_request(path: Column, width: Column, height: Column) -> Column:
    """A request for a scaled image: struct of status (200, 400 or 404), id, format, width and height.

    The path is ``/image/<hex and dashes>.<jpg, jpeg, png or webp>`` in any case; sizes are whole
    numbers from 1 to 4000, a missing, zero or unreadable one is not given.
    """
    pattern = r"(?i)^/image/([0-9a-f-]+)\.(jpg|jpeg|png|webp)$"
    kind = F.lower(F.regexp_extract(path, pattern, 2))
    w, h = leading_int(width), leading_int(height)
    w, h = F.when(w != 0, w), F.when(h != 0, h)
    bad = F.coalesce((w < 1) | (w > 4000), F.lit(False)) | F.coalesce((h < 1) | (h > 4000), F.lit(False))
    status = F.when(F.coalesce(kind, F.lit("")) == "", 404).when(bad, 400).otherwise(200)
    ok = status == 200
    return F.struct(
        status.alias("status"),
        F.when(status != 404, F.regexp_extract(path, pattern, 1)).alias("id"),
        F.when(status != 404, F.when(kind == "jpeg", F.lit("jpg")).otherwise(kind)).alias("format"),
        F.when(ok, w).alias("width"),
        F.when(ok, h).alias("height"),
    )
