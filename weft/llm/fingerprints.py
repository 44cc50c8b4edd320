"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame operations only.

A text is cut, without losing a character, into sections (after blank lines) and
these into paragraphs (after line ends).  A paragraph's node is the SHA-256 of its
text, a section's that of its paragraphs' nodes (both cut to 128 bits), the root
that of the sections' nodes.  Below its node a paragraph keeps 32-bit hashes of
its pieces (sentences, or 64 characters of a longer one), by which likeness is
measured.  The fingerprint is the written tree:

    root ":" section "/" section ...   with   section = node "=" paragraph ";" paragraph ...
                                       and    paragraph = node "." piece "," piece ...

Equal texts have equal roots and fingerprints; two fingerprints are compared
from the root down (``differing_branches``), which locates edits; their
likeness is the share of pieces in common (Dice), 1 only for equal roots.

Edge cases: null text is the empty text (one empty paragraph); two empty
texts are alike (1), an empty and another are not (0).  Rows that repeat an id
are documents of their own whose next document is that of the next larger id;
of several rows with that id it is the one with the smallest text hash.  The
last id's next is the first, so a single id is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._rows import keyed, real_id

FAN = 4096
PIECE = r"(?s)[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+"
SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)(?!\n)"


def _node(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def tree(text: Column) -> Column:
    """array<array<struct<node, pieces>>>: paragraphs by section."""
    def paragraph(p: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x).bitwiseAND(0xFFFFFFFF))
        return F.struct(_node(p).alias("node"), pieces.alias("pieces"))

    return F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), paragraph))


def leaves(tree_col: str | Column) -> Column:
    """The distinct pieces of a tree."""
    return F.array_distinct(F.flatten(F.transform(F.flatten(tree_col), lambda p: p["pieces"])))


def sections(tree_col: str | Column) -> Column:
    """The sections' nodes."""
    return F.transform(tree_col, lambda s: _node(F.array_join(F.transform(s, lambda p: p["node"]), "")))


def root(tree_col: str | Column) -> Column:
    return F.sha2(F.array_join(sections(tree_col), "").cast("binary"), 256)


def written(tree_col: str | Column) -> Column:
    """The fingerprint string."""
    def piece(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(h), 8, "0"))

    def paragraph(p: Column) -> Column:
        return F.concat(p["node"], F.lit("."), F.array_join(F.transform(p["pieces"], piece), ","))

    def section(node: Column, s: Column) -> Column:
        return F.concat(node, F.lit("="), F.array_join(F.transform(s, paragraph), ";"))

    return F.concat(root(tree_col), F.lit(":"), F.array_join(F.zip_with(sections(tree_col), tree_col, section), "/"))


def likeness(equal: Column, a: Column, b: Column) -> Column:
    """Dice's share of distinct pieces ``a`` and ``b``; 1 only for equal roots."""
    n = F.size(a) + F.size(b)
    dice = F.when(n > 0, 2.0 * F.size(F.array_intersect(a, b)) / n).otherwise(0.0)
    return F.when(equal, 1.0).otherwise(F.least(dice, 1.0 - 1.0 / (n + 2.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row."""
    k = keyed(docs).withColumn("tree", tree(F.col("text")))
    return k.select(
        real_id("did").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        written("tree").alias("fingerprint"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _branches(fingerprint: Column) -> Column:
    """array<struct<section, paragraph, key>>: a key is a paragraph's node and the how manieth of that node it is."""
    sections = F.split(F.substring_index(fingerprint, ":", -1), "/")

    def within(s: Column, i: Column) -> Column:
        paragraphs = F.split(F.substring_index(s, "=", -1), ";")
        return F.transform(paragraphs, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.substring_index(p, ".", 1).alias("node")))

    def keyed_ones(all_: Column) -> Column:
        nth = lambda x, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda y: y["node"] == x["node"])).cast("string")
        return F.transform(all_, lambda x, i: F.struct(
            x["section"].alias("section"), x["paragraph"].alias("paragraph"), F.concat_ws("#", x["node"], nth(x, i)).alias("key")
        ))

    return _let(F.flatten(F.transform(sections, within)), keyed_ones)


def _in_order(common: Column) -> Column:
    """Of pairs (i, j) in the order of i, the places of a longest run whose j rise too."""
    def longest(acc: Column, c: Column) -> Column:
        """The length of the longest such run that ends at each pair."""
        below = F.transform(acc, lambda n, k: F.when(common[k]["j"] < c["j"], n).otherwise(0))
        return F.concat(acc, F.array(F.coalesce(F.array_max(below), F.lit(0)) + 1))

    def back(best: Column) -> Column:
        start = F.struct(F.array_max(best).alias("need"), F.lit(1 << 62).alias("bound"), F.array().cast("array<int>").alias("kept"))

        def step(s: Column, k: Column) -> Column:
            taken = F.struct((s["need"] - 1).alias("need"), common[k]["j"].alias("bound"), F.concat(s["kept"], F.array(k)).alias("kept"))
            return F.when((best[k] == s["need"]) & (common[k]["j"] < s["bound"]), taken).otherwise(s)

        return F.aggregate(F.sequence(F.size(best) - 1, F.lit(0), F.lit(-1)), start, step, lambda s: s["kept"])

    none = F.array().cast("array<int>")
    return F.when(F.size(common) == 0, none).otherwise(_let(F.aggregate(common, none, longest), back))


def differing_branches(a: str | Column, b: str | Column) -> Column:
    """array<struct<section, paragraph, side>>: branches, from 0, in which fingerprints ``a`` and ``b`` differ; [] for equal roots.

    Paragraphs are aligned by their nodes: those of equal nodes in the same order on both sides are the same. All others
    differ: side "a" has what isn't in b or stands elsewhere there, side "b" what isn't in a or has come from elsewhere. So
    an inserted or deleted paragraph is one branch, a changed or moved one is one on each side. The work grows with the
    square of the paragraphs' number.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    kind = "array<struct<section:int,paragraph:int,side:string>>"

    def left(side: str, own: Column, kept: Column) -> Column:
        rest = F.filter(own, lambda x, i: ~F.array_contains(kept, i))
        return F.transform(rest, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"), F.lit(side).alias("side")))

    def align(x: Column) -> Column:
        other = F.transform(x["b"], lambda y: y["key"])
        pairs = F.transform(x["a"], lambda y, i: F.struct(i.alias("i"), F.array_position(other, y["key"]).alias("j")))

        def rest(common: Column) -> Column:
            return _let(_in_order(common), lambda kept: F.concat(
                left("a", x["a"], F.transform(kept, lambda k: common[k]["i"])),
                left("b", x["b"], F.transform(kept, lambda k: (common[k]["j"] - 1).cast("int"))),
            ))

        return _let(F.filter(pairs, lambda p: p["j"] > 0), rest)

    found = _let(F.struct(_branches(a).alias("a"), _branches(b).alias("b")), align).cast(kind)
    same_root = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same_root, F.array().cast(kind)).otherwise(found)


def _successors(t: DataFrame, lo: int, hi: int, wrap: int) -> DataFrame:
    """(key, nxt) of (key, val): the val of the next larger key, ``wrap`` after the largest; keys are distinct in lo..hi.

    Keys are ordered in blocks of FAN consecutive values; the blocks' first rows,
    one for each block, are linked the same way.
    """
    if hi - lo < FAN:
        return t.select("key", F.lead("val", 1, wrap).over(Window.orderBy("key")).alias("nxt"))
    t = t.withColumn("block", F.shiftright("key", FAN.bit_length() - 1))
    inner = t.select("key", "block", F.lead("val").over(Window.partitionBy("block").orderBy("key")).alias("inner"))
    heads = t.groupBy("block").agg(F.min_by("val", "key").alias("val")).select(F.col("block").alias("key"), "val")
    after = _successors(heads, lo // FAN, hi // FAN, wrap).select(F.col("key").alias("block"), F.col("nxt").alias("outer"))
    return inner.join(after, "block").select("key", F.coalesce("inner", "outer").alias("nxt"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(did, next_did) for each distinct id: its successor, the first after the last."""
    ids = ids.select("did").distinct()
    ends = ids.agg(F.min("did").alias("lo"), F.max("did").alias("hi")).first()
    lo, hi = (0, 0) if ends["lo"] is None else (ends["lo"], ends["hi"])
    linked = _successors(ids.select(F.col("did").alias("key"), F.col("did").alias("val")), lo, hi, lo)
    return linked.select(F.col("key").alias("did"), F.col("nxt").alias("next_did"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, with their likenesses.

    The edited text swaps the last floor(n / 2) code points for the first as many of the next document.
    """
    base = keyed(docs).select("did", "text")  # the same columns for both joins below, which share one exchange of the texts
    half = F.floor(F.length("text") / 2).cast("int")
    needs = base.groupBy("did").agg(F.max(half).alias("need"))
    after = next_ids(base).join(needs, "did").select(F.col("did").alias("for_did"), "need", "next_did")
    nxt = base.join(after, base["did"] == after["next_did"]).withColumn(
        "r", F.row_number().over(Window.partitionBy("did", "for_did").orderBy(F.xxhash64("text")))
    )
    nxt = nxt.where("r = 1").select(
        "for_did",
        F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"),
        tree(F.col("text")).alias("next_tree"),
    )
    nxt = nxt.select("for_did", "head", root("next_tree").alias("next_root"), leaves("next_tree").alias("next_leaves"))
    d = base.join(nxt, base["did"] == nxt["for_did"]).withColumn("n", F.length("text"))
    cut = F.floor(F.col("n") / 2).cast("int")
    d = d.withColumn(
        "edited",
        F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - cut), F.substring(F.col("head"), F.lit(1), cut)),
    )
    d = d.withColumn("tree", tree(F.col("text"))).withColumn("edited_tree", tree(F.col("edited")))
    d = d.withColumn("leaves", leaves("tree"))
    return d.select(
        real_id("did").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("tree").alias("fingerprint"),
        written("edited_tree").alias("edited_fingerprint"),
        likeness(root("tree") == root("edited_tree"), F.col("leaves"), leaves("edited_tree")).alias("near_edited"),
        likeness(root("tree") == F.col("next_root"), F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )
