"""Text analysis as column expressions: tokens, sentences, chunk classes, intents, page joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character ranges that count as CJK, kana or Hangul.
CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}"

#: Words by the default Unicode word boundaries: ideographs and Hiragana one by one, Katakana runs, and runs of letters,
#: marks, digits and underscores that apostrophes, points and commas join inside. Possessive, ASCII first: no part of a
#: run is tried twice.
_LETTERS = "[\\p{L}\\p{N}&&[^\\p{ASCII}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}]]"
_RUN = f"(?:[A-Za-z0-9_]++|{_LETTERS}++)(?:[A-Za-z0-9_]++|{_LETTERS}++|\\p{{M}}++)*+"
WORD = (
    f"{_RUN}(?:(?:(?<=\\p{{L}})['’.:·](?=\\p{{L}})|(?<=\\p{{N}})['’.,;](?=\\p{{N}})){_RUN})*"
    "|[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{309F}]|[\\x{30A0}-\\x{30FF}]+"
)
KEPT_SINGLE = f"^[0-9b-hj-zB-HJ-Z{CJK}]$"
SENTENCE = "[^.?!。]*[.?!。]|[^.?!。]+$"

#: Phrases that classify a chunk, in the order in which the classes are tried.
DEFINITION = ["is defined as", "refers to", "means that", "is a type of", "can be defined as", "is known as"]
EXAMPLE = ["for example", "e.g.", "for instance", "such as", "example:"]
PROCEDURE = ["step 1", "step 2", "first,", "then,", "finally,", "how to", "procedure", "instructions"]
COMPARISON = ["vs", "versus", "compared to", "in contrast", "on the other hand", "differs from", "difference between"]
BULLETS = "•●\\-*①②③④"
CHUNK_TYPES = ["definition", "example", "list", "procedure", "comparison", "general"]

#: Messages of invalid commands.
EMPTY_INPUT = "Empty input"
TERM_REQUIRED = "Term required for /define. Usage: /define <term>"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside another lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    """White space of any kind and length as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def tokens(c: Column) -> Column:
    """Search terms of a text, lower-cased, repeats kept. Single letters are kept but for `a` and `i`, single digits and
    ideographs too, other single characters not; a null text has none."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: ((F.length(w) > 1) & (F.btrim(w, F.lit("_")) != "")) | w.rlike(KEPT_SINGLE))
    return F.transform(kept, lambda w: F.lower(w))


def keep_token(c: Column) -> Column:
    return (F.length(c) > 1) | c.rlike(KEPT_SINGLE)


def is_cjk(c: Column) -> Column:
    """Whether a text has a CJK, kana or Hangul character."""
    return c.rlike(f"[{CJK}]")


def sentences(c: Column) -> Column:
    """Trimmed sentences; a lone full stop is none."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SENTENCE), F.lit(0)), trim_all)
    return F.filter(parts, lambda s: (F.octet_length(s) > 1) | ((F.length(s) > 0) & ~s.rlike("[.?!。]$")))


def sentence_key(c: Column) -> Column:
    """What makes two sentences the same: lower case, white space collapsed."""
    return collapse(F.lower(c))


def without_repeats(found: Column) -> Column:
    """Sentences without later repeats, in order: sorted by what makes them the same, the first of each, sorted back."""
    keyed = F.sort_array(F.transform(found, lambda s, i: F.struct(sentence_key(s).alias("key"), i.alias("i"), s.alias("s"))))
    firsts = let(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["key"] != x["key"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def distinct_sentences(c: Column) -> Column:
    return without_repeats(sentences(c))


def cut_to(c: Column, most: int) -> Column:
    """At most so many characters, then back to the last sentence end if there is one; 0: no limit."""
    if most <= 0:
        return c
    ended = let(F.substring(c, 1, most), lambda head: F.when(head.rlike("[.?!。]"), F.regexp_extract(head, "(?s)^(.*[.?!。])", 1)).otherwise(head))
    return F.when(F.length(c) > most, ended).otherwise(c)


def compressed(c: Column, most: int = 0, remove_duplicates: bool = True) -> Column:
    """Struct of the shortened text and its figures."""
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)

    def figures(x):
        return let(
            cut_to(x["joined"], most),
            lambda result: F.struct(
                result.alias("text"),
                n.cast("long").alias("original_chars"),
                F.length(result).cast("long").alias("compressed_chars"),
                F.when(n > 0, F.round(F.length(result) / n, 6)).otherwise(F.lit(1.0)).alias("ratio"),
                x["removed"].cast("long").alias("sentences_removed"),
                F.lit(0).cast("long").alias("chars_saved_stopwords"),
                (F.length(x["joined"]) - F.length(result)).cast("long").alias("chars_saved_truncation"),
            ),
        )

    def kept(all_of):
        rest = without_repeats(all_of) if remove_duplicates else all_of
        return let(rest, lambda r: F.struct(F.array_join(r, " ").alias("joined"), (F.size(all_of) - F.size(r)).alias("removed")))

    return let(let(sentences(text), kept), figures)


def should_compress(c: Column, threshold: int) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4) > threshold


def truncation_limit(c: Column) -> Column:
    """Subword tokens kept of a text: 256, 384 from 1,200 characters on, 512 from 2,400 on."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n >= 2400, 512).when(n >= 1200, 384).otherwise(256)


def significant_terms(c: Column) -> Column:
    """Distinct lower-cased query terms of two characters or more, or with an ideograph, in first-seen order."""
    parts = F.split(F.coalesce(c, F.lit("")), "[\\s()\\[\\]{},.!?:;/|_\\-]+")
    kept = F.filter(parts, lambda w: (F.length(w) > 0) & (is_cjk(w) | (utf16_length(w) >= 2)))
    return F.array_distinct(F.transform(kept, lambda w: F.lower(w)))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _has_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def _count(text: Column, phrases: list[str]) -> Column:
    return sum((F.when(text.contains(p), 1).otherwise(0) for p in phrases), F.lit(0))


def list_lines(c: Column) -> Column:
    """Lines that begin with a bullet, or with a digit and a point or bracket."""
    lines = F.transform(F.split(c, "\n"), trim_all)
    return F.size(F.filter(lines, lambda s: s.rlike(f"^[{BULLETS}]") | ((F.octet_length(s) > 2) & s.rlike("^\\p{N}[.)]"))))


def chunk_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(list_lines(c) >= 3, "list")
        .when(_has_any(low, DEFINITION), "definition")
        .when(_has_any(low, EXAMPLE), "example")
        .when(_count(low, PROCEDURE) >= 2, "procedure")
        .when(_has_any(low, COMPARISON), "comparison")
        .otherwise("general")
    )


def known_chunk_type(c: Column) -> Column:
    """The type's name, `general` for any other string."""
    return F.when(F.lower(c).isin(CHUNK_TYPES), F.lower(c)).otherwise(F.lit("general"))


def chunking_strategy(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, "\\.([^.]+)$", 1)).isin("md", "markdown"), "markdown").otherwise("recursive")


def intent(c: Column) -> Column:
    """Struct of intent_type, query, is_valid and error_message of a user's input."""
    text = trim_all(F.coalesce(c, F.lit("")))
    parts = F.split(text, " ", 2)
    command = F.lower(F.get(parts, F.lit(0)))
    argument = trim_all(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    slash = text.startswith("/")
    bare = (command == "/define") & (argument == "")
    known = command.isin("/summary", "/more") | ((command == "/define") & (argument != ""))
    empty = text == ""
    kind = (
        F.when(empty, "invalid").when(~slash, "general").when(command == "/summary", "summary").when(command == "/more", "more")
        .when((command == "/define") & (argument != ""), "define").otherwise("invalid")
    )
    query = F.when(empty, "").when(~slash, text).when(known, argument).otherwise(command)
    message = (
        F.when(empty, EMPTY_INPUT).when(~slash | known, F.lit(None).cast("string")).when(bare, TERM_REQUIRED)
        .otherwise(F.concat(F.lit("Unknown command '"), command, F.lit("'. Available: /summary, /define, /more")))
    )
    return F.struct(kind.alias("intent_type"), query.alias("query"), (kind != "invalid").alias("is_valid"), message.alias("error_message"))


# Pages

HYPHENS = "\\-\\x{AD}\\x{2010}\\x{2011}"


def strip_page_number(page: Column) -> Column:
    """Without the last line that is not blank, if it is digits only. Blank lines after it stay."""
    whole = F.split(page, "\r?\n")
    lines = F.when(page.endswith("\n"), F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)

    def without(found):
        places = F.filter(F.transform(found, lambda s, i: F.when(trim_all(s) != "", i)), lambda i: i.isNotNull())
        last = F.coalesce(F.array_max(places), F.lit(0))
        return let(
            last,
            lambda at: F.when(
                trim_all(F.coalesce(F.get(found, at), F.lit(""))).rlike("^[0-9]+$"),
                F.array_join(F.filter(found, lambda s, i: i != at), "\n"),
            ).otherwise(page),
        )

    return let(lines, without)


def dehyphenate(c: Column) -> Column:
    """Words broken by a hyphen at a line's end, where the next line goes on in lower case."""
    return F.regexp_replace(c, f"(?U)(\\w+)[{HYPHENS}]\\s*[\\r\\n]+\\s*([a-z]\\w*)", "$1$2")


def join_pages(pages: Column) -> Column:
    """An array of page texts as one: page numbers go, words broken between pages are joined, white space is collapsed."""
    broken = f"(?U)\\w[{HYPHENS}]\\s*$"

    def add(so_far, page):
        meets = so_far.rlike(broken) & page.rlike("(?U)^\\s*\\w")
        joined = F.concat(F.regexp_replace(so_far, f"(?U)[{HYPHENS}]\\s*$", ""), F.regexp_replace(page, "(?U)^\\s+", ""))
        return F.when(meets, joined).otherwise(F.concat(so_far, F.lit(" "), page))

    clean = F.transform(pages, strip_page_number)
    whole = F.aggregate(F.slice(clean, 2, 1_000_000_000), F.coalesce(F.get(clean, F.lit(0)), F.lit("")), add)
    return collapse(dehyphenate(whole))


def join_cjk_lines(c: Column) -> Column:
    """Line breaks between two ideographs, kana or Hangul go without a space."""
    return F.regexp_replace(c, f"(?<=[{CJK}])[ \\t]*[\\r\\n]+[ \\t]*(?=[{CJK}])", "")


def document_kind(content: Column) -> Column:
    """Of a binary document: pdf, docx, or the error: too large (over 50 MB), too small, unsupported."""
    return (
        F.when(F.octet_length(content) > 50 * 1024 * 1024, "too large").when(F.octet_length(content) < 4, "too small")
        .when(F.substring(F.hex(content), 1, 8) == "25504446", "pdf").when(F.substring(F.hex(content), 1, 4) == "504B", "docx")
        .otherwise("unsupported")
    )


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
