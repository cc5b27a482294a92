"""Document fingerprints: a Merkle tree of pieces, paragraphs and sections.

Lines are paragraphs. A paragraph's leaves are its pieces, whose bounds depend on the few characters around them alone: a
piece ends after punctuation that white space follows, and after the full-width or other scripts' punctuation. What is
longer than `LONG` characters also ends after every word whose hash is one of an eighth of all, and what is then still
longer than `UNBROKEN`, as in scripts without spaces or in encoded data, after every character whose window of four has a hash of a
thirty-second of all. A paragraph's node hashes its leaves, a section ends after a paragraph whose node starts with 0 or 1 (eight paragraphs on
average, and the same ones after an edit elsewhere), its node hashes its paragraphs' nodes, the root hashes the sections'.
So an edit changes the leaves that it touches and their branch; only windows of giant unbroken runs are also parted every
`BLOCK` characters. Hashes have 128 bits at every level, so equal roots are equal texts.

A fingerprint is `root:tree`; the tree lists the leaves, shortened to 64 bits where they are printed, parted by `,` in a
paragraph, `;` between paragraphs and `/` between sections. Likeness counts leaves, and leaves with the leaf that follows,
as often as they occur: order and repetition matter. Texts whose roots differ are never quite alike. The place of an edit
is told in paragraphs and, for texts of few lines, in pieces. Every step is a built-in function, so a text is read once
and nothing leaves the JVM.

Defined results. A null text is empty; the empty text has a fingerprint. Two empty texts are alike (1.0), an empty and
another are not (0.0). Repeated ids are ordered by their text; null ids come last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Punctuation that ends a piece at white space, and that which ends it anywhere.
POINTS, WIDE_POINTS = ".!?;,:", "。！？；：，、।॥။።،؛؟"
PIECE = f"[^\\n]+?(?:[{POINTS}]+[ \\t]+|[{WIDE_POINTS}]+|\\z)"
#: Characters from which on a piece is parted by hashes of words, then by those of windows; a window's characters, and what
#: is parted into windows at once.
LONG, UNBROKEN, WINDOW, BLOCK = 96, 256, 4, 8192
#: Words and windows whose hashes start so end a piece: one of 8, one of 32.
WORD, WORD_CUT, CUT = "[^ \\t]*[ \\t]+|[^ \\t]+", "[01]", "0[0-7]"
#: Hex digits of a root, and of a leaf as it is printed.
ROOT, LEAF = 32, 16
#: The most that texts with different roots can be alike.
NOT_EQUAL = 0.999999
#: Rows a bucket of neighbouring ids should hold, and the most buckets; beyond them buckets grow and sort to disk.
ROWS, MOST = 2000, 65536
LOWEST = -(1 << 63)


def _bound(node: Column) -> Column:
    return F.when(node.startswith("0") | node.startswith("1"), F.lit("/")).otherwise(F.lit(";"))


def _windows(block: Column) -> Column:
    """A run of characters, parted after each window whose hash says so."""

    def marked(chars: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            window = F.concat(*[F.get(chars, i - k) for k in range(WINDOW - 1, 0, -1)], c)
            return F.when(F.md5(window).rlike("^" + CUT), F.concat(c, F.lit("\n"))).otherwise(c)

        return F.array_join(F.transform(chars, one), "")

    # The characters are bound once by an array around them.
    text = F.get(F.transform(F.array(F.split(block, "")), marked), F.lit(0))
    return F.array_remove(F.split(text, "\n"), "")


def _words(piece: Column) -> Column:
    """A piece, parted after each word whose hash says so."""
    one = lambda w: F.when(F.md5(w).rlike("^" + WORD_CUT), F.concat(w, F.lit("\n"))).otherwise(w)
    return F.array_remove(F.split(F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(WORD), F.lit(0)), one), ""), "\n"), "")


def pieces(paragraph: Column) -> Column:
    """The pieces of a paragraph, in order; together they are the paragraph."""
    short = lambda p: F.length(p) <= LONG
    blocks = lambda p: F.regexp_extract_all(p, F.lit(f"[^\\n]{{1,{BLOCK}}}"), F.lit(0))
    by_windows = lambda p: F.when(F.length(p) <= UNBROKEN, F.array(p)).otherwise(F.flatten(F.transform(blocks(p), _windows)))
    by_words = lambda p: F.when(short(p), F.array(p)).otherwise(F.flatten(F.transform(_words(p), by_windows)))
    whole = lambda found: F.when(F.forall(found, short), found).otherwise(F.flatten(F.transform(found, by_words)))
    return F.get(F.transform(F.array(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0))), whole), F.lit(0))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the fingerprint of column `text` (not null) as `name`."""
    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(pieces(p), F.md5))
    df = df.withColumn("__leaves", leaves).withColumn("__nodes", F.transform("__leaves", lambda x: F.md5(F.array_join(x, ","))))
    marked = F.transform("__nodes", lambda h: F.concat(h, _bound(h)))
    sections = F.transform(F.split(F.array_join(marked, ""), "/"), F.md5)
    root = F.md5(F.array_join(sections, "/"))
    printed = lambda x: F.array_join(F.transform(x, lambda h: F.substring(h, 1, LEAF)), ",")
    tree = F.array_join(F.zip_with("__leaves", "__nodes", lambda x, h: F.concat(printed(x), _bound(h))), "")
    return df.withColumn(name, F.concat(root, F.lit(":"), tree)).drop("__leaves", "__nodes")


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, ROOT)


def _tree(fingerprint: Column) -> Column:
    return F.substring(fingerprint, ROOT + 2, 2147483647)


def with_leaves(df: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """`df` with the printed leaves of a fingerprint, in order, as `name`."""
    return df.withColumn(name, F.array_remove(F.split(_tree(F.col(fingerprint)), "[,;/]"), ""))


def with_items(df: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """`df` with the leaves of a fingerprint, and each with the leaf after it, as hashes `name`. The n-th of equal ones is
    told apart from the others, so that sets of items are compared as the lists they come from."""
    leaves = "__flat"
    df = with_leaves(df, fingerprint, leaves)
    pairs = F.zip_with(F.slice(leaves, F.lit(2), F.size(leaves)), leaves, lambda after, x: F.xxhash64(x, F.coalesce(after, F.lit("$"))))
    df = df.withColumn("__sorted", F.sort_array(F.concat(F.transform(leaves, lambda x: F.xxhash64(x)), pairs)))
    fresh = F.transform("__sorted", lambda x, i: F.when((i == 0) | (F.get("__sorted", i - 1) != x), i))
    df = df.withColumn("__starts", F.filter(fresh, lambda i: i.isNotNull()))
    end = lambda j: F.coalesce(F.get("__starts", j + 1), F.size("__sorted"))
    nth = F.transform("__starts", lambda i, j: F.transform(F.sequence(F.lit(1), end(j) - i), lambda n: F.xxhash64(F.get("__sorted", i), n)))
    # Mostly no two are equal, and the first ones are all there are.
    return df.withColumn(name, F.when(F.size("__starts") == F.size("__sorted"), F.transform("__sorted", lambda x: F.xxhash64(x, F.lit(1)))).otherwise(F.flatten(nth))).drop("__flat", "__sorted", "__starts")


def likeness(a: str, b: str, a_items: str, b_items: str) -> Column:
    """1.0 for equal roots, else twice the shared items over all items of both, from columns already made."""
    shared = F.size(F.array_intersect(a_items, b_items))
    both = F.size(a_items) + F.size(b_items)
    part = F.least(F.round(2.0 * shared / F.greatest(both, F.lit(1)), 6), F.lit(NOT_EQUAL))
    return F.when(root(F.col(a)) == root(F.col(b)), 1.0).otherwise(part)


def _first_gap(a: Column, b: Column) -> Column:
    """The first place (from 0) where two arrays differ."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.greatest(F.size(a), F.size(b)).cast("long"))


def with_gaps(df: DataFrame, a: str, b: str, first: str, last: str, equal: Column) -> DataFrame:
    """`df` with the number of elements at the head of array `a` that `b` shares as `first`, and of those at its tail as
    `last`, none counted twice; both are -1 where `equal`."""
    df = df.withColumn(first, _first_gap(F.col(a), F.col(b)).cast("long"))
    tail = F.least(_first_gap(F.reverse(a), F.reverse(b)).cast("long"), F.least(F.size(a), F.size(b)) - F.col(first))
    df = df.withColumn(last, F.when(equal, -1).otherwise(F.greatest(tail, F.lit(0))).cast("long"))
    return df.withColumn(first, F.when(equal, -1).otherwise(F.col(first)).cast("long"))


def with_edits(df: DataFrame, a: str, b: str) -> DataFrame:
    """`df` with edit_first, edit_last (paragraphs) and piece_first, piece_last (leaves) of fingerprint `b` against `a`."""
    equal = root(F.col(a)) == root(F.col(b))
    for side, f in (("a", a), ("b", b)):
        df = with_leaves(df, f, f"__leaves_{side}")
        # A mark ends every paragraph, so what follows the last one is none.
        df = df.withColumn(f"__lines_{side}", F.split(F.regexp_replace(_tree(F.col(f)), "[;/]$", ""), "[;/]"))
    df = with_gaps(df, "__lines_a", "__lines_b", "edit_first", "edit_last", equal)
    return with_gaps(df, "__leaves_a", "__leaves_b", "piece_first", "piece_last", equal).drop("__lines_a", "__lines_b", "__leaves_a", "__leaves_b")


def _bucket(ident: Column, cuts: list[int]) -> Column:
    """How many cuts are below the id, by binary search in a literal array."""
    width = 1
    while width < len(cuts) + 1:
        width *= 2
    steps = []
    while width > 1:
        width //= 2
        steps.append(width)
    padded = F.array(*[F.lit(c) for c in cuts]) if len(cuts) <= 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(padded, at + s - 1) < ident, F.lit(False)), at + s).otherwise(at),
    )


def with_next(docs: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """`docs` with next_<c> for each column: its value in the row of the next smaller id; after the last, of the first.

    Ids are dealt into buckets at quantiles. A bucket's largest id is a cut, and its row also goes to the bucket above
    as a ghost, so each bucket is sorted on its own and no task sees the whole order."""
    docs = docs.withColumn("__id", F.coalesce(F.col(ident).cast("long"), F.lit(LOWEST)))
    n, top = docs.agg(F.count("*"), F.max("__id")).first()
    wanted = min(MOST, max(1, -(-n // ROWS)))
    cuts: list[int] = []
    if wanted > 1:
        at = [i / wanted for i in range(1, wanted)]
        cuts = docs.agg(F.percentile_approx("__id", at, max(10_000, 10 * wanted))).first()[0]
        cuts = sorted({int(c) for c in cuts} - {top})
    edges = [*cuts, top if top is not None else 0]
    bucket = _bucket(F.col("__id"), cuts)
    place = lambda b, ghost: F.struct(b.cast("int").alias("b"), F.lit(ghost).alias("g"))
    docs = docs.withColumn("__b", bucket)
    is_cut = F.lit(False)
    if cuts:
        listed = F.from_json(F.lit(str(edges)), "array<bigint>")
        is_cut = (F.col("__b") < len(cuts)) & (F.get(listed, F.col("__b")) == F.col("__id"))
    places = F.array_compact(
        F.array(
            place(F.col("__b"), False),
            F.when(is_cut, place(F.col("__b") + 1, True)),
            F.when(F.col("__id") == F.lit(edges[-1]), place(F.lit(0), True)),
        )
    )
    rows = docs.select("*", F.inline(F.transform(places, lambda p: F.struct(p["b"].alias("__to"), p["g"].alias("__ghost")))))
    w = Window.partitionBy("__to").orderBy("__ghost", F.desc("__id"), *columns)
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.filter(~F.col("__ghost")).drop("__id", "__b", "__to", "__ghost")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edit_first, edit_last, piece_first, piece_last: the paragraphs and pieces at the head and the tail that the edited text
    shares; the edit lies between. All are -1 for equal texts.

    The edited text has its last third replaced by the start of the next document's, in descending order of ids."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_tree(df, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    df = with_tree(df, "edited", "edited_fingerprint")
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        df = with_items(df, name, f"__{name}")
    df = with_edits(df, "fingerprint", "edited_fingerprint")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", "__fingerprint", "__edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", "__fingerprint", "__next_fingerprint").alias("near_next"),
        "edit_first",
        "edit_last",
        "piece_first",
        "piece_last",
    )
