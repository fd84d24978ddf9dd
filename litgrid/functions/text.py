"""Text, date and identifier functions as Column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from litgrid.functions.xml import well_formed

# fixed values
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "shy": "\u00ad"}
#: White space as runs of it are collapsed.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
SUPERSCRIPTS = {"0": "⁰", "1": "¹", "2": "²", "3": "³", "4": "⁴", "5": "⁵", "6": "⁶", "7": "⁷", "8": "⁸", "9": "⁹", "+": "⁺", "-": "⁻", "=": "⁼", "(": "⁽", ")": "⁾", "n": "ⁿ", "i": "ⁱ"}
SUBSCRIPTS = {"0": "₀", "1": "₁", "2": "₂", "3": "₃", "4": "₄", "5": "₅", "6": "₆", "7": "₇", "8": "₈", "9": "₉", "+": "₊", "-": "₋", "=": "₌", "(": "₍", ")": "₎"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UID_LETTERS = {"67": "C", "68": "D", "81": "Q"}
ELLIPSIS = "…"


def decode_entities(c: Column) -> Column:
    """One pass over well-formed references: seven names, in any case, and numbers; unknown names and numbers out of range stay as written."""
    parts = F.regexp_extract_all(c, F.lit(r"(?is)(&(?:#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]*);|&|[^&]+)"), F.lit(1))
    names = F.create_map(*(F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv))

    def one(p: Column) -> Column:
        name = F.lower(F.substring(p, F.lit(2), F.length(p) - 2))
        digits = F.when(p.rlike("(?i)^&#x"), F.try_to_number(F.conv(F.substring(name, F.lit(3), F.lit(12)), 16, 10), F.lit("9" * 20))).otherwise(F.substring(name, F.lit(2), F.lit(19)).try_cast("decimal(20,0)"))
        code = digits.cast("decimal(20,0)")
        fine = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(p)
        return F.when(~p.rlike("(?s)^&.*;$"), p).when(p.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(names, name), p))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def display_text(c: Column) -> Column:
    """Markup as text: tags go, then entities are decoded, soft hyphens go and white space collapses. A `<` that no letter follows is no tag, nor is what has another bracket in it, so comparisons stay."""
    return collapse(F.replace(decode_entities(F.regexp_replace(c, "</?[A-Za-z][^<>]*>", " ")), F.lit("\u00ad"), F.lit("")))


def html_text(c: Column) -> Column:
    """A page's text: comments and the contents of scripts, styles and navigation go first."""
    out = F.regexp_replace(c, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return display_text(out)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def utf16_slice(c: Column, limit: int | Column) -> Column:
    """The first `limit` UTF-16 units, one less where the cut would divide a pair."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    units = F.encode(c, "UTF-16LE")
    last = F.substring(F.hex(F.substring(units, 2 * limit - 1, 2)), 3, 2)
    cut = F.when(last.between("D8", "DB"), limit - 1).otherwise(limit)
    return F.when(utf16_length(c) <= limit, c).otherwise(F.decode(F.substring(units, F.lit(1), 2 * cut), "UTF-16LE"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def nonblank(c: Column) -> Column:
    """A text that is worked out once; null where it is empty."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def clip(shown: Column, limit: int) -> Column:
    """`limit` UTF-16 units at most, with an ellipsis where the text was cut."""
    return F.when(utf16_length(shown) > limit, F.concat(utf16_slice(shown, limit), F.lit(ELLIPSIS))).otherwise(shown)


def snippet(c: Column, limit: int = 400) -> Column:
    """Display text of `limit` UTF-16 units at most, with an ellipsis where it was cut."""
    return let(display_text(c), lambda shown: clip(shown, limit))


def _script(c: Column, tag: str, table: dict[str, str], prefix: str) -> Column:
    """The contents of un-nested tags as Unicode characters where all have one, else after a prefix."""
    keys = "".join(table)

    def one(p: Column) -> Column:
        inner = F.regexp_extract(p, rf"(?is)^<{tag}>([^<]*)</{tag}>$", 1)
        mapped = F.translate(inner, keys, "".join(table.values()))
        whole = F.length(F.translate(inner, keys, "")) == 0
        return F.when(~p.rlike(rf"(?is)^<{tag}>[^<]*</{tag}>$"), p).when(inner == "", F.lit("")).when(whole, mapped).otherwise(F.concat(F.lit(prefix), inner))

    def flat(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(rf"(?is)(<{tag}>[^<]*</{tag}>|<|[^<]+)"), F.lit(1))
        return F.when(F.contains(F.lower(x), F.lit(f"<{tag}>")), F.array_join(F.transform(parts, one), "")).otherwise(x)

    # what one tag makes of a text is used three times by the next
    return let(c, flat)


def flatten_inline(c: Column) -> Column:
    """Superscripts and subscripts as characters, other inline tags dropped with their contents kept."""
    out = F.regexp_replace(c, r"(?i)</?(?:b|i|u|sc)>", "")
    for tag, table, prefix in (("sup", SUPERSCRIPTS, "^"), ("sub", SUBSCRIPTS, "_"), ("inf", SUBSCRIPTS, "_")):
        out = _script(out, tag, table, prefix)
    return out


def month_number(c: Column) -> Column:
    """1 to 12 from a month's name or number; null for anything else."""
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)))
    return F.coalesce(F.when(F.length(F.trim(c)) <= 2, F.trim(c).try_cast("int")), F.try_element_at(names, F.lower(F.substring(F.trim(c), 1, 3))))


def partial_date(c: Column) -> Column:
    """`2020`, `2020 Mar`, `2020 Mar 5`, `2020 Jul-Aug` and `2020 Jan/Feb` as a date string of the first day meant; an unknown month or an impossible day gives null."""
    # month and day with one pattern, that is matched once: the parts come out as one text between marks
    pattern = r"^\s*([0-9]{4})(?:[ /-]+([A-Za-z]+|[0-9]{1,2}))?(?:[-/][A-Za-z]+)?(?:[ /-]+([0-9]{1,2}))?\s*$"
    whole = F.split(F.regexp_replace(c, pattern, "$1|$2|$3"), r"\|")

    def made(p: Column) -> Column:
        day = F.coalesce(F.nullif(F.get(p, F.lit(2)), F.lit("")).try_cast("int"), F.lit(1))
        month = F.when(F.get(p, F.lit(1)) == "", F.lit(1)).otherwise(month_number(F.get(p, F.lit(1))))
        return F.when(F.size(p) == 3, F.date_format(F.try_make_timestamp_ntz(F.get(p, F.lit(0)).try_cast("int"), month, day, F.lit(0), F.lit(0), F.lit(0)), "yyyy-MM-dd"))

    return F.get(F.transform(F.array(whole), made), F.lit(0))


def standard_date(c: Column) -> Column:
    """A partial date, else what one of a few common formats reads; null if none does."""
    tries = [F.date_format(F.try_to_timestamp(c, F.lit(f)), "yyyy-MM-dd") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy/MM/dd HH:mm", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy")]
    return F.coalesce(partial_date(c), *tries)


def date_bounds(lo: str, hi: str) -> tuple[str, str]:
    """Partial dates YYYY[/MM[/DD]] (also with - or .) widened to the first and the last day meant."""
    import calendar

    def parts(s: str) -> list[int]:
        return [int(x) for x in s.replace("-", "/").replace(".", "/").split("/")]

    a, b = parts(lo), parts(hi)
    a += [1] * (3 - len(a))
    if len(b) == 1:
        b.append(12)
    if len(b) == 2:
        b.append(calendar.monthrange(b[0], b[1])[1])
    return "{:04d}-{:02d}-{:02d}".format(*a), "{:04d}-{:02d}-{:02d}".format(*b)


def author_display(names: Column, most: int = 3) -> Column:
    """The first names, then `et al.` if there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.lit(", et al.")).otherwise(F.lit("")))


def year_of(year: Column, free_form: Column) -> Column:
    return F.coalesce(year, F.nullif(F.regexp_extract(free_form, r"\d{4}", 0), F.lit("")))


def _page_parts(c: Column) -> Column:
    """The parts of a page range, trimmed; blank ones are null."""
    return F.transform(F.split(c, "[-–—]"), lambda p: nonblank(F.trim(p)))


def page_start(c: Column) -> Column:
    return F.get(_page_parts(c), F.lit(0))


def page_end(c: Column) -> Column:
    """The end of a page range; a shortened one takes its first digits from the start."""

    def ended(parts: Column) -> Column:
        start, end = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        short = F.length(end) < F.length(start)
        return F.when(start.isNotNull() & short, F.concat(F.substring(start, F.lit(1), F.length(start) - F.length(end)), end)).when(start.isNotNull(), end)

    return let(_page_parts(c), ended)


def decode_uid(c: Column) -> Column:
    """Eight digits that begin with 67, 68 or 81: a letter and the last six; anything else as it is."""
    out = c
    for digits, letter in UID_LETTERS.items():
        out = F.when(c.rlike(f"^{digits}[0-9]{{6}}$"), F.concat(F.lit(letter), F.substring(c, 3, 6))).otherwise(out)
    return out


def bare_pmcid(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^PMC", "")


def pmcid(c: Column) -> Column:
    return F.concat(F.lit("PMC"), bare_pmcid(c))


def doi(c: Column) -> Column:
    """A DOI without scheme or prefix; null if it doesn't begin with 10."""
    out = F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    out = F.trim(F.regexp_replace(out, r"(?i)^doi:\s*", ""))
    return F.when(out.startswith("10."), out)


def trailing_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)/?\s*$", 1), F.lit(""))


def is_pmid(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def is_pmcid(c: Column) -> Column:
    return c.rlike(r"(?i)^(PMC)?\d+$")


def is_doi(c: Column) -> Column:
    return doi(c).isNotNull()


def is_record_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:/-]{0,63}$")


def surname(c: Column) -> Column:
    """The first word, in lower case."""
    return F.lower(F.get(F.split(F.trim(c), r"\s+"), F.lit(0)))


def uri_component(c: Column) -> Column:
    """Percent-encoding of a URI's component, unlike a form's: spaces are %20, and ! ' ( ) * ~ stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def flag(c: Column) -> Column:
    """Y and N as booleans; absent stays absent."""
    return F.when(c.isNotNull(), c == "Y")


def sanitise_error(c: Column) -> Column:
    """A message fit to show: exception traces become a short text, addresses a placeholder."""
    trace = c.rlike(r"(?is)\bat [\w.$]+\(|Traceback|Exception")
    return F.when(trace, F.lit("The upstream service failed.")).otherwise(F.regexp_replace(c, r"https?://\S+", "[url]"))


def article_url(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))


def fulltext_url(pmc: Column) -> Column:
    return F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid(pmc), F.lit("/"))


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/?term="), uri_component(query))


def corpus_url(source: Column, record: Column) -> Column:
    return F.concat(F.lit("https://europepmc.org/article/"), source, F.lit("/"), record)


def string_list(c: Column) -> Column:
    """A JSON value that is one member or a list of them, as an array of strings; null is null."""
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(F.regexp_replace(F.trim(c), '^"|"$', "")))


def nested(c: Column, path: str) -> Column:
    """What stands at a dotted path of a JSON text, as text; null if any step is missing."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")))


def content_kind(url_for_pdf: Column, head: Column) -> Column:
    """pdf or html: by the first characters of what was fetched, else by which address it came from."""
    return F.when(head.startswith("%PDF"), "pdf").when(head.rlike(r"(?is)^\s*<(!doctype html|html|head|body)"), "html").when(url_for_pdf.isNotNull(), "pdf").otherwise("html")


def payload_kind(c: Column) -> Column:
    """What a reply is before it is parsed: html, empty (nothing but a prolog), error, invalid or xml; a parser tells the last two apart."""
    body = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<\?xml[^?]*\?>", ""), r"(?i)<!DOCTYPE[^>]*>", ""))
    html, empty = c.rlike(r"(?i)^\s*<(!doctype\s+html|html[\s>])"), c.isNull() | (F.regexp_replace(body, r"\s+", "") == "")
    fine = well_formed(F.when(~html & ~empty, c))
    return F.when(html, "html").when(empty, "empty").when(~fine, "invalid").when(body.rlike(r"(?i)<error>"), "error").otherwise("xml")
