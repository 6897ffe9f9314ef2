"""Scalar functions as column expressions: identifiers, titles, briefs, tokens, numbers, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: fixed values: words that say nothing in a title or query
STOP = ["a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with", "without"]
#: fixed values: titles that name no subject
GENERIC = r"(?i)^(general|overview|introduction|scope)$|^abnormal cases\b"
#: fixed values: boilerplate in briefs
BOILERPLATE = [r"(?i)\bETSI TS \d{3} \d{3} V[\d.]+ \(\d{4}-\d{2}\)", r"(?i)\b3GPP TS \d{2}\.\d{3} version [\d.]+ Release \d+\b", r"(?i)\bETSI\b"]


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def first_match(x: Column, *shapes: tuple[str, object]) -> Column | None:
    """The value of the first shape (pattern, function of its groups) that matches."""
    out = None
    for pattern, value in shapes:
        made = value(lambda i, p=pattern: F.regexp_extract(x, p, i))
        out = F.when(x.rlike(pattern), made) if out is None else out.when(x.rlike(pattern), made)
    return out


def joined(*parts: Column) -> Column:
    """The parts that are not empty, by underscores."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "_")


def normalize_id(raw: Column) -> Column:
    """A document identifier in its one form, from any of its spellings; ``unknown`` if null or empty."""
    x = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, r"_v?\d+[.\-]\d+[.\-]\d+.*$", ""), r"_(2g3g|5g|lte|umts)_.+$", "")
    six = lambda g: joined(g(1), F.substring(g(2), 2, 2), F.substring(g(2), 4, 3), g(3))
    shapes = [
        (r"^(ts|tr)\s+(\d+)\.(\d+)(?:[-.](\d+))?$", lambda g: joined(g(1), g(2), g(3), g(4))),
        (r"^(ts|tr)_(\d{6})(?:[-_](\d+))?$", six),
        (r"^(ts|tr)_\d+_\d+(_\d+)?$", lambda g: g(0)),
        (r"^(ts|tr)_(\d{6})-(\d+)_.*$", six),
    ]
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[.\-\s]+", "_"), "_+", "_"), "_$", "")
    return F.when(raw.isNull() | (raw == ""), "unknown").otherwise(first_match(x, *shapes).otherwise(other))


def stem(name: Column) -> Column:
    """A file name without folders and its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", ""))


def id_of_file(name: Column) -> Column:
    """The document identifier that a file name tells; its order of shapes is not that of ``normalize_id``."""
    x = stem(name)
    shapes = [
        (r"^(ts|tr)_(\d{2})_(\d{3})(?:_(\d+))?", lambda g: joined(g(1), g(2), g(3), g(4))),
        (r"^(ts|tr)[\s_]*(\d{2})\.(\d{3})", lambda g: joined(g(1), g(2), g(3))),
        (r"^(ts|tr)[_\s]*1(\d{2})(\d{3})", lambda g: joined(g(1), g(2), g(3))),
        (r"^(ts|tr)[_\s]*(\d{2})(\d{3})", lambda g: joined(g(1), g(2), g(3))),
    ]
    return first_match(x, *shapes).otherwise(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def version_of_file(name: Column) -> Column:
    """``v18.9.0`` in a file name, or empty."""
    found = F.regexp_extract(stem(name), r"v(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", F.concat(F.lit("v"), found)).otherwise("")


def release_of_file(name: Column) -> Column:
    """The version that the letter and two digits before the extension stand for (a: 10 to k: 20, others 0), or empty."""
    shape = r"-([a-z])(\d)(\d)\.(docx?|zip)$"
    x = F.lower(name)
    part = lambda i: F.regexp_extract(x, shape, i)
    release = F.when(part(1).between("a", "k"), F.ascii(part(1)) - 87).otherwise(0)
    return F.when(x.rlike(shape), F.concat(F.lit("v"), F.concat_ws(".", release.cast("string"), part(2), part(3)))).otherwise("")


def clean_title(title: Column) -> Column:
    """Without dot leaders and page number, inner white space as one blank."""
    return collapsed(F.regexp_replace(F.coalesce(title, F.lit("")), r"\.{2,}\s*\d*\s*$", ""))


def parent_id(section_id: Column) -> Column:
    """The section above, null for top sections."""
    x = F.regexp_extract(section_id, r"^([^:]*:.*)\.[^.]*$", 1)
    return F.when(x != "", x)


def depth(number: Column) -> Column:
    return F.when(number.isNull() | (number == ""), 0).otherwise(F.size(F.split(number, r"\.")) - 1)


def _words(x: Column, limit: int) -> Column:
    """The first ``limit`` characters, back to the last blank if that is beyond 60 %, and an ellipsis."""
    cut = F.substring(x, 1, limit)
    blank = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    return F.concat(F.when(blank > limit * 0.6, F.substring(cut, F.lit(1), blank)).otherwise(cut), F.lit("…"))


def brief(text: Column, limit: int = 180) -> Column:
    """At most ``limit`` characters: all, or the first sentence, or whole words and an ellipsis."""
    x = collapsed(text)
    end = F.regexp_instr(x, F.lit(r"[.!?]\s"))
    return F.when(F.length(x) <= limit, x).when((end > 1) & (end <= limit), F.substring(x, F.lit(1), end)).otherwise(_words(x, limit))


def memo_brief(text: Column, limit: int = 200) -> Column:
    """As ``brief``, but the first sentence must end beyond 40 % of ``limit``."""
    x = collapsed(text)
    end = F.regexp_instr(F.substring(x, 1, limit), F.lit(r"[.!?]\s"))
    return F.when(F.length(x) <= limit, x).when((end > 0) & (end + 1 > limit * 0.4), F.substring(x, F.lit(1), end)).otherwise(_words(x, limit))


def span_brief(text: Column) -> Column:
    return F.trim(F.substring(F.coalesce(text, F.lit("")), 1, 200))


def summary(text: Column, limit: int = 220) -> Column:
    """Without boilerplate, cut to ``limit`` with dots; null if nothing is left."""
    x = text
    for pattern in BOILERPLATE:
        x = F.regexp_replace(x, pattern, " ")
    x = F.nullif(collapsed(x), F.lit(""))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 3), F.lit("..."))).otherwise(x)


def is_generic(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(GENERIC)


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    """Words of the normalised text without stop words."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: (w != "") & ~w.isin(STOP))


def label(spec_id: Column, number: Column) -> Column:
    """How a section is named to a reader: ``TS 24 301 §5.5``."""
    return F.concat(F.upper(F.replace(spec_id, F.lit("_"), F.lit(" "))), F.lit(" §"), number)


def delivery_number(series: Column, doc: Column, sub: Column) -> Column:
    """100000 + series * 1000 + doc, then two digits of the part, if there is one."""
    n = (F.lit(100000) + series * 1000 + doc).cast("string")
    return F.when(sub.isNull(), n).otherwise(F.concat(n, F.lpad(sub.cast("string"), 2, "0")))


def mapped_id(kind: Column, number: Column) -> Column:
    """The document identifier of a delivery number; null if it has none."""
    prefix = F.regexp_replace(kind, "^etsi_", "")
    base = F.when(F.length(number) >= 8, F.substring(number, 1, 6)).otherwise(number)
    n = base.cast("int") - 100000
    part = F.when(F.length(number) >= 8, F.substring(number, 7, 10).cast("int").cast("string")).otherwise("")
    valid = prefix.isin("ts", "tr") & number.rlike(r"^\d+$") & (F.length(base) == 6) & (n >= 0)
    return F.when(valid, joined(prefix, F.lpad(F.floor(n / 1000).cast("string"), 2, "0"), F.lpad((n % 1000).cast("string"), 3, "0"), part))


def range_directory(number: Column) -> Column:
    low = F.floor(number / 100) * 100
    return F.concat_ws("_", low.cast("string"), (low + 99).cast("string"))


def version_display(version: Column) -> Column:
    """``18.09.00`` as ``18.9.0``."""
    return F.array_join(F.transform(F.split(version, r"\."), lambda p: p.cast("int").cast("string")), ".")


def delivery_url(base: str, kind: Column, number: Column, version: Column) -> Column:
    """Where a version's file lies below ``base``."""
    name = F.concat(kind, F.lit("_"), number, F.lit("v"), F.replace(version, F.lit("."), F.lit("")), F.lit("p.pdf"))
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.concat(F.lit("etsi_"), kind), range_directory(number.cast("long")), number, F.concat(version, F.lit("_60")), name)


def normalize_kind(kind: Column) -> Column:
    """A publication type with its prefix."""
    x = F.lower(F.trim(kind))
    return F.when(x.startswith("etsi_"), x).otherwise(F.concat(F.lit("etsi_"), x))


def normalize_mapped(spec: Column) -> Column:
    """(id, label) of a mapped document, from any spelling."""
    x = F.trim(spec)
    like = F.regexp_replace(F.lower(x), r"[\s.\-]+", "_")
    part = lambda i: F.element_at(F.split(like, "_"), i)
    more = F.when(F.size(F.split(like, "_")) > 3, F.concat(F.lit("-"), F.get(F.split(like, "_"), F.lit(3)).cast("int").cast("string"))).otherwise("")
    known = like.rlike(r"^(ts|tr)_\d{2}_\d{3}(?:_\d+)?$")
    tight = r"(?i)^(TS|TR)(\d{2})\.(\d{3})(?:-(\d+))?$"
    got = lambda i: F.regexp_extract(x, tight, i)
    sub = F.when(got(4) != "", got(4).cast("int").cast("string")).otherwise("")
    label_ = F.concat(F.upper(got(1)), F.lit(" "), got(2), F.lit("."), got(3), F.when(sub != "", F.concat(F.lit("-"), sub)).otherwise(""))
    return (
        F.when(known, F.struct(like.alias("id"), F.concat(F.upper(part(1)), F.lit(" "), part(2), F.lit("."), part(3), more).alias("label")))
        .when(x.rlike(tight), F.struct(joined(F.lower(got(1)), got(2), got(3), sub).alias("id"), label_.alias("label")))
        .otherwise(F.struct(like.alias("id"), F.upper(x).alias("label")))
    )


def split_mapped(spec: Column) -> Column:
    """(kind, number) of ``TS 24.301``; the kind is empty if there is none."""
    x = F.trim(F.coalesce(spec, F.lit("")))
    two = x.rlike(r"^\S+\s+\S")
    return F.struct(F.when(two, F.lower(F.regexp_extract(x, r"^(\S+)", 1))).otherwise("").alias("kind"), F.when(two, F.regexp_extract(x, r"^\S+\s+(.*)$", 1)).otherwise(F.coalesce(spec, F.lit(""))).alias("number"))


def memo_number(identifier: Column) -> Column:
    """The number in ``rfc_3261``; null if it is none."""
    found = F.regexp_extract(F.lower(identifier), r"^rfc_?(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def series_of(spec_id: Column) -> Column:
    """The series of a specification; reports and memos have none."""
    return F.nullif(F.regexp_extract(spec_id, r"^ts_(\d+)_", 1), F.lit(""))


def iso_date(stamp: Column) -> Column:
    """The date of an ISO time as written; other texts without white space at the ends."""
    return F.trim(F.regexp_replace(stamp, "T.*$", ""))


def heading_kind(line: Column) -> Column:
    """``numbered``, ``annex`` or ``named`` for a heading, else null. The line's white space at the ends does not count."""
    x = F.regexp_replace(line, r"^\s+|\s+$", "")
    #: fixed values: headings without a number
    named = ["foreword", "introduction", "scope", "references", "definitions", "abbreviations"]
    return F.when(x.rlike(r"^\d+(?:\.\d+)*\s+\S"), "numbered").when(x.rlike(r"^Annex\s+[A-Z](?:\.\d+)*\s*(?:\((?:normative|informative)\))?\s*:?\s*\S"), "annex").when(F.lower(x).isin(named), "named")


def heading_number(line: Column) -> Column:
    """The number of a numbered or annex heading; empty for others."""
    x = F.regexp_replace(line, r"^\s+|\s+$", "")
    number = F.regexp_extract(x, r"^(\d+(?:\.\d+)*)\s", 1)
    return F.when(number != "", number).otherwise(F.regexp_extract(x, r"(?i)^(Annex\s+[A-Z](?:\.\d+)*)", 1))


def without_number(title: Column, number: Column) -> Column:
    """A title without the number that it starts with."""
    return F.regexp_replace(F.when((number != "") & title.startswith(number), F.substring(title, F.length(number) + 1, F.length(title))).otherwise(title), r"^\s+|\s+$", "")


def citations(text: Column) -> Column:
    """Array of (target_id, ref_type, citation_text) in order, of both kinds of documents; the part of a number is not kept."""
    specs = F.regexp_extract_all(text, F.lit(r"(?i)(?:3GPP[\s\x{a0}]+)?(?:TS|TR)[\s\x{a0}]+\d{2,3}\.\d{3}"), 0)
    memos = F.regexp_extract_all(text, F.lit(r"(?i)\bRFC[\s\x{a0}\-–]\d{3,5}\b"), 0)
    spec = lambda c: F.struct(joined(F.lower(F.regexp_extract(c, r"(?i)(TS|TR)[\s\x{a0}]+\d", 1)), F.regexp_extract(c, r"(\d{2,3})\.\d{3}$", 1), F.regexp_extract(c, r"(\d{3})$", 1)).alias("target_id"), F.lit("3gpp").alias("ref_type"), F.trim(c).alias("citation_text"))
    memo = lambda c: F.struct(F.concat(F.lit("rfc_"), F.regexp_extract(c, r"(\d+)$", 1)).alias("target_id"), F.lit("rfc").alias("ref_type"), F.trim(c).alias("citation_text"))
    return F.concat(F.transform(specs, spec), F.transform(memos, memo))


def prefixed(prefix: str, text: Column) -> Column:
    """``text`` for the embedder, after ``query:`` or ``passage:``, in place of such a prefix that it has."""
    x = F.regexp_replace(collapsed(text), r"(?i)^(query|passage):\s*", "")
    return F.when(collapsed(text) == "", F.lit(prefix)).otherwise(F.trim(F.concat(F.lit(prefix + " "), x)))


def passage(spec_id: Column, number: Column, title: Column, content: Column, limit: int = 4000) -> Column:
    """A section's header line and content for the embedder."""
    name = F.replace(F.regexp_replace(F.regexp_replace(spec_id, "(?i)^ts_", "TS "), "(?i)^rfc_", "RFC "), F.lit("_"), F.lit("."))
    parts = F.array(F.coalesce(name, F.lit("")), F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("Section "), number)).otherwise(""), collapsed(title))
    return F.substring(F.trim(F.concat(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit("\n"), collapsed(content)), F.lit(" \n")), 1, limit)


def unescaped(text: Column) -> Column:
    """The five named entities and the quote by number."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def joined_url(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``: absolute ones stay, ``/x`` counts from the host, others from the folder."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), href))


def round3(x: Column) -> Column:
    """Half up to three places."""
    return F.floor(x * 1000 + 0.5) / 1000
