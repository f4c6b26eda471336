"""Text functions as column expressions, with ASCII classes wherever engines differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ACRONYMS, CONTENT_STOPWORDS, KEY_PARAMETER, SMALL_WORDS, TECHNIQUE_STOPWORDS


def slug(name: Column) -> Column:
    """Lower case, every other character than a letter or digit an underscore, trimmed of them."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def camel_words(name: Column) -> Column:
    """Words of a name, split at case changes and other characters; lower case, in order, distinct."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != ""))


def compact(name: Column) -> Column:
    """A name's letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def content_tokens(text: Column) -> Column:
    """Distinct ASCII identifiers of three characters or more, lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]{2,})"), F.lit(1))
    return F.array_except(found, F.array(*[F.lit(w) for w in sorted(CONTENT_STOPWORDS)]))


def technique_terms(name: Column) -> Column:
    """Search terms of a technique: its words over two characters, sorted, without stop words."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*sorted(TECHNIQUE_STOPWORDS)))
    return F.array_sort(F.array_distinct(kept))


def title_variant(title: Column) -> Column:
    """The title with every word but the first in lower case."""
    return F.concat(F.substring_index(title, " ", 1), F.lower(F.substring(title, F.length(F.substring_index(title, " ", 1)) + 1, 1_000_000)))


def display_title(identifier: Column) -> Column:
    """An identifier as a title: acronyms upper, small words lower unless first, others capitalised."""
    words = F.split(identifier, "_")

    def one(w, i):
        return F.when(w.isin(*ACRONYMS), F.upper(w)).when(w.isin(*SMALL_WORDS) & (i > 0), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))

    return F.array_join(F.transform(words, one), " ")


#: White space at either end of a text, as Python strips it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def trim_sentence(text: Column, limit: int) -> Column:
    """At most ``limit`` characters and an ellipsis, ending with the last sentence if that is beyond 40 % of them.

    A sentence ends with a full stop and a space or a line feed.
    """
    text = strip(text)
    head = F.substring(text, 1, limit)
    back = F.regexp_instr(F.reverse(head), F.lit(r"[ \n]\."))
    stop = F.when(back > 0, F.length(head) - back).otherwise(0)
    short = F.when(stop - 1 > limit * 0.4, F.substring(head, F.lit(1), stop)).otherwise(F.rtrim(head, F.lit(BLANKS)))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit(" \u2026")))


def is_matrix(value: Column) -> Column:
    """Whether a flattened list has eight commas or more."""
    return F.length(value) - F.length(F.replace(value, F.lit(","), F.lit(""))) >= 8


def matrix_view(values: Column) -> dict[str, Column]:
    """Size, diagonal and off-diagonal flag of a flattened square matrix (an array of numbers)."""
    n = F.size(values)
    side = F.floor(F.sqrt(n.cast("double")) + 0.5).cast("int")
    square = (side >= 2) & (side * side == n)
    steps = F.sequence(F.lit(0), side - 1)
    diagonal = F.transform(steps, lambda i: F.element_at(values, i * (side + 1) + 1))
    off = F.exists(F.sequence(F.lit(0), n - 1), lambda k: (k % (side + 1) != 0) & (F.element_at(values, k + 1) != 0))
    return {"side": F.when(square, side), "diagonal": F.when(square, diagonal), "off_diagonal": F.when(square, off)}


def flags(values: Column, names: Column) -> Column:
    """Names whose flag in ``values`` is true, in order."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), names.alias("n")), lambda z: z["v"]), lambda z: z["n"])


def bare_letter(symbol: Column) -> Column:
    """The letter of a symbol such as ``x_k`` or a bold ``R``: one that no other letter follows."""
    plain = F.trim(F.regexp_replace(symbol, r"\\(?:mathbf|boldsymbol|bm)\{([A-Za-z0-9_]+)\}", "$1"))
    return F.regexp_extract(plain, "^([A-Za-z])(?![A-Za-z])", 1)


def section_numbers(text: Column) -> Column:
    """Dotted numbers that follow "section", "sec." or a section sign."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?:section|sec\\.|\u00a7) ?([0-9]+(?:\\.[0-9]+)*)"), F.lit(1))


def base_document(identifier: Column) -> Column:
    """The part of a document id before ``#``."""
    return F.substring_index(identifier, "#", 1)


def outer_json(text: Column) -> Column:
    """The text itself if it is JSON, else from the first brace to the last one, fences and prose around it dropped."""
    whole = strip(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole).otherwise(inner)


def redact(text: Column, secrets: tuple[str, ...] = (), mark: str = "***") -> Column:
    """Values of ``key=`` parameters in a text masked, and any listed secrets."""
    text = F.regexp_replace(text, KEY_PARAMETER, f"$1{mark}")
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit(mark))
    return text


def added_percent(size: Column, added: Column) -> Column:
    """Growth in per cent of what was there before, 100 where nothing was."""
    return F.when(size == added, F.lit(100.0)).otherwise(100.0 * added / (size - added))


def header_notice(text: Column) -> Column:
    """The comment block that opens a source text without its marks, null if there is none or it names no copyright."""
    block = F.regexp_extract(text, r"(?s)^\s*/\*(.*?)\*/", 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\* ?", ""), r"\s+$", ""))
    notice = strip(F.array_join(lines, "\n"))
    return F.when(notice.contains("Copyright"), notice)


def html_safe(text: Column) -> Column:
    """JSON text safe inside a script element."""
    for c, r in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(c), F.lit(r))
    return text


def earned_state(passed: Column, presented: Column, available: Column) -> Column:
    """demonstrated for as many presented and passed as are available, read for some passed, else null: nothing is earned."""
    return F.when(passed <= 0, F.lit(None).cast("string")).when((presented >= available) & (passed >= available), "demonstrated").when(passed > 0, "read")


def excerpt(text: Column, n: int = 400) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column, n: int = 300) -> Column:
    """White space collapsed, at most n characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t-\r]+", " ")), 1, n)
