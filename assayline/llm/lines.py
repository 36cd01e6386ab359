"""Repeated and nearly repeated lines across documents, with DataFrame functions only.

Method: a segment-partition edit join.  A line of n characters is cut into ``edits`` + 1 segments; a line within
``edits`` edits of it holds at least one of them, at a place that the lengths and the segment's number confine to a few
positions.  Segments are indexed under their line's length and probed with those substrings of equal and longer
lines.  Entries are first counted without their lines; only lines that share one are looked at again.  Of these, pairs whose letters,
characters or pairs of characters differ too much are dismissed, all others are verified by banded bit-parallel edit distance (bit
vectors of vertical differences, 2 * edits + 1 wide).  A segment that many different lines share is not joined pair by pair: all
that look it up are compared with one of its lines, and links connect lines to classes.  Lines that are still apart are told apart by a sketch of their
characters (parities of their counts), by two of its 2 * edits + 2 parts for every choice of two, because ``edits`` edits leave two parts or
more unchanged; in these smaller crowds they are compared with one line outside the first component, a few times, and then pair by pair across
components only.  So to find the classes a group of n near lines costs in the order of n comparisons, and no link between components is lost.
The number of links is counted over all pairs within ``edits`` edits: both lines of such a pair are in one class, so the lines of a class
are compared with each other (those of a large one only if two parts of their sketches agree), in blocks and without keeping the pairs.

What is removed: lines are compared without white space at their ends.  Of equal lines the first (by id, then line
number) stays, and of a class of lines that are connected by steps of up to ``edits`` edits only its first line.
Lines shorter than ``SHORTEST`` characters are never removed, those shorter than ``SHORTEST_NEAR`` only if equal.

Cases: null texts stay null and take no part, nor do rows with a null id; both are passed on unchanged.  Documents
stay even if no line is left (their text is then empty); an empty table gives empty ones, and other columns may have any name.  Rows that repeat an id share their line numbers: equal places
are one place, so identical rows keep identical lines.  Very long lines are compared whole.  Lines are told apart by 128
bits of hash, and links name them by 64 bits of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import MOST_SHIPPED, discard, only, shipped, written
from assayline.llm.links import smallest_reachable
from assayline.plans.joins import split_join

EDITS = 2
SHORTEST, SHORTEST_NEAR = 10, 30
#: Lines that may share an entry of the index and still be compared each with each; rounds of comparing a crowd with one line.
MOST_SHARED = 24
STARS = 1
#: Lines of a crowd that a task compares with all others of it, about.
BLOCK_LINES = 4096
# Letters dealt into groups of about equal frequency in European languages; other characters are in no group.
_GROUPS = ("e", "ta", "oi", "ns", "hrd", "lucm", "fwgypbvkxjqz")


def lines_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, line_no, line (trimmed) and its number of characters; null ids and texts have none."""
    lines = docs.select(
        F.col(f"`{key}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("line_no", "raw")
    ).where("doc is not null")
    line = F.btrim("raw", F.lit(" \t\r"))
    return lines.select("doc", "line_no", line.alias("line")).withColumn("n", F.char_length("line"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b")]


def _mark(line_no: str | Column, a: str | Column) -> Column:
    """A line at its place; rows that repeat an id may hold different lines at one number."""
    return F.xxhash64(line_no, a)


def _segment(length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment of a line of ``length`` characters; the last ones are the longer ones."""
    longer = (length % (edits + 1)).cast("int")
    base = ((length - longer) / (edits + 1)).cast("int")
    first_longer = F.lit(edits + 1) - longer
    return base * number + F.greatest(F.lit(0), number - first_longer), base + (number >= first_longer).cast("int")


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(characters shorter, segment, shift) of the substrings that a line must be looked up with to meet all lines that are at most ``edits`` characters shorter."""
    return [
        (shorter, number, shift)
        for shorter in range(edits + 1)
        for number in range(edits + 1)
        for shift in range(max(-number, shorter - (edits - number)), min(number, shorter + (edits - number)) + 1)
    ]


def _literals(rows: list[tuple], names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names.split())]) for row in rows])


def entries(lines: DataFrame, edits: int) -> DataFrame:
    """The rows of ``lines`` with every entry (hash of a length, a segment's number and a substring) that they look up, and whether it is their ``own``.

    A line looks up its own segments too, so these rows are the index and what it is probed with.
    """
    rows = lines.select("*", F.explode(_literals(probe_places(edits), "shorter number shift")).alias("p"))
    length = F.col("n") - F.col("p.shorter")
    rows = rows.where(length >= SHORTEST_NEAR).withColumn("length", length)
    start, size = _segment(F.col("length"), F.col("p.number"), edits)
    rows = rows.withColumns({"at": start + F.col("p.shift"), "size": size}).where("at >= 0 and at + size <= n")
    entry = F.xxhash64("length", "p.number", F.substring(F.col("line"), F.col("at") + 1, F.col("size")))
    return rows.select(*lines.columns, entry.alias("entry"), F.expr("p.shorter = 0 and p.shift = 0").alias("own"))


def letter_counts(line: Column) -> Column:
    return F.array(*[F.char_length(line) - F.char_length(F.translate(line, group, "")) for group in _GROUPS])


def sketch(line: Column) -> Column:
    """Bit k: whether the characters whose code point is k modulo 64 are odd in number.  An edit turns two bits at most."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.split(line, ""), F.lit(0).cast("long"),
        lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(64)))),
    )


def pair_sketch(line: Column) -> Column:
    """The same of neighbouring characters, by a hash of both.  An edit turns four bits at most."""
    one = F.lit(1).cast("long")
    start = F.struct(F.lit("").alias("before"), F.lit(0).cast("long").alias("bits"))

    def step(s: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", one, F.pmod(F.xxhash64(s["before"], c), F.lit(64)).cast("int"))
        return F.struct(c.alias("before"), s["bits"].bitwiseXOR(bit).alias("bits"))

    return F.aggregate(F.split(line, ""), start, step, lambda s: s["bits"])


#: What is known of a line when it meets others.
_FEATURES = ("n", "sketch", "pairs", "letters")


def _other(rows: DataFrame, *keys: str) -> DataFrame:
    """The same lines as the other side of a pair: ``c`` and its features under names that end in 2."""
    return rows.select(*keys, F.col("a").alias("c"), *[F.col(f).alias(f + "2") for f in _FEATURES])


def _near(edits: int) -> Column:
    """Whether the features of two lines leave it possible that they are within ``edits`` edits."""
    differ = lambda f: F.bit_count(F.col(f).bitwiseXOR(F.col(f + "2")))
    apart = F.aggregate(F.zip_with("letters", "letters2", lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d.cast("int"))
    return (
        (F.col("a") != F.col("c")) & (F.abs(F.col("n") - F.col("n2")) <= edits)
        & (differ("sketch") <= 2 * edits) & (differ("pairs") <= 4 * edits) & (apart <= 2 * edits)
    )


def _part_masks(edits: int) -> list[int]:
    """The bits of a sketch dealt into 2 * edits + 2 parts, as signed numbers."""
    parts = 2 * edits + 2
    masks = [sum(1 << b for b in range(64) if b % parts == i) for i in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def told_apart(crowd: DataFrame, edits: int) -> DataFrame:
    """Rows (with ``entry`` and ``sketch``) of crowded entries once for every choice of two sketch parts, under what the sketch holds there.

    2 * edits bits that differ leave at least two parts alike, so lines within ``edits`` edits meet again.
    """
    masks = _part_masks(edits)
    choices = _literals([(i, masks[g] | masks[h]) for i, (g, h) in enumerate(combinations(range(len(masks)), 2))], "choice mask")
    rows = crowd.select("*", F.explode(choices).alias("c"))
    parts = F.xxhash64("entry", "c.choice", F.col("sketch").bitwiseAND(F.col("c.mask")))
    return rows.withColumn("entry", parts).withColumn("choice", F.col("c.choice")).drop("c")


def _first_choice(difference: Column, edits: int) -> Column:
    """Of the choices of two parts without a difference, the first; a pair is taken where it meets under that one."""
    masks = _part_masks(edits)
    pairs = _literals([(i, masks[g] | masks[h]) for i, (g, h) in enumerate(combinations(range(len(masks)), 2))], "choice mask")
    return F.get(F.filter(pairs, lambda c: difference.bitwiseAND(c["mask"]) == 0), F.lit(0))["choice"]


def _bits(value: int) -> Column:
    return F.lit(value).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; inside a lambda an expression would be computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_common_ends(pair: Column) -> Column:
    """A struct of strings x and y without their common beginning and end, which leaves the edit distance as it is.

    Lengths are found by halving; of strings over 2 ** 17 characters some of the common ends may stay.
    """
    steps = F.array(*[F.lit(1 << b) for b in range(16, -1, -1)])

    def head(s: Column, k: Column, step: Column) -> Column:
        return F.substring(s, k + 1, step)

    def tail(s: Column, k: Column, step: Column) -> Column:
        return F.substring(s, F.char_length(s) - k - step + 1, step)

    def common(part: Callable, p: Column, most: Column) -> Column:
        return F.aggregate(
            steps, F.lit(0),
            lambda k, step: F.when((k + step <= most) & (part(p["x"], k, step) == part(p["y"], k, step)), k + step).otherwise(k),
        )

    def inner(s: Column, p: Column) -> Column:
        return F.substring(s, p["head"] + 1, F.char_length(s) - p["head"] - p["tail"])

    def with_head(p: Column) -> Column:
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), p["most"].alias("most"), common(head, p, p["most"]).alias("head"))

    def with_tail(p: Column) -> Column:
        return F.struct(
            p["x"].alias("x"), p["y"].alias("y"), p["head"].alias("head"), common(tail, p, p["most"] - p["head"]).alias("tail")
        )

    measured = _let(
        pair, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.least(F.char_length(p["x"]), F.char_length(p["y"])).alias("most"))
    )
    return _let(_let(_let(measured, with_head), with_tail), lambda p: F.struct(inner(p["x"], p).alias("x"), inner(p["y"], p).alias("y")))


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two strings, right wherever it is at most ``edits``; more elsewhere.

    Common ends are taken off first.  Column j of the table of distances is then held for the rows j - edits to
    j + edits: where it rises and where it falls from row to row as bits, and the value of the topmost row.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def equal(left: Column, at: Column) -> Column:
        bits = [F.when(F.get(left, at["j"] - edits + k) == at["c"], _bits(1 << k)).otherwise(_bits(0)) for k in range(width)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    def reached(s: Column, below: Column) -> Column:
        """The value in the last row's diagonal, which never falls."""
        return s["value"] + F.bit_count(s["up"].bitwiseAND(below)) - F.bit_count(s["down"].bitwiseAND(below))

    def step(s: Column, eq: Column) -> Column:
        up = F.shiftright(s["up"], 1).bitwiseOR(_bits(top))  # the row that enters is taken to rise
        down = F.shiftright(s["down"], 1)
        same = (eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(_bits(mask))
        rises = down.bitwiseOR(same.bitwiseOR(up).bitwiseXOR(_bits(mask)))
        falls = same.bitwiseAND(up)
        rises, falls = (F.shiftleft(v, 1).bitwiseAND(_bits(mask)) for v in (rises, falls))
        return F.struct(
            falls.bitwiseOR(same.bitwiseOR(rises).bitwiseXOR(_bits(mask))).alias("up"),
            rises.bitwiseAND(same).alias("down"),
            (s["value"] + 1 - same.bitwiseAND(_bits(1))).cast("int").alias("value"),
        )

    # Before the first column the distance of row i is |i|; rows above the first stand for an equal beginning.
    start = F.struct(
        _bits(mask & ~((2 << edits) - 1)).alias("up"), _bits((2 << edits) - 1).alias("down"), _bits(edits).alias("value")
    )

    def table(v: Column) -> Column:
        columns = F.transform(v["right"], lambda c, j: F.struct(c.alias("c"), j.alias("j")))

        def column(s: Column, at: Column) -> Column:
            spent = reached(s, v["below"]) > edits
            return F.when(spent, s).otherwise(F.aggregate(F.array(equal(v["left"], at)), s, step))

        return F.aggregate(columns, start, column, lambda s: reached(s, v["below"]))

    def distance(p: Column) -> Column:
        m, n = p["m"], p["n"]
        arrays = F.struct(
            F.split(p["x"], "").alias("left"), F.split(p["y"], "").alias("right"),
            (F.call_function("shiftleft", _bits(2), m - n + edits) - 2).alias("below"),  # the rows between the topmost and the last
        )
        return F.when(F.abs(m - n) > edits, edits + 1).when(F.least(m, n) == 0, F.greatest(m, n)).otherwise(_let(arrays, table))

    sized = _let(
        _without_common_ends(F.struct(x.alias("x"), y.alias("y"))),
        lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.char_length(p["x"]).alias("m"), F.char_length(p["y"]).alias("n")),
    )
    return _let(sized, distance)


class LineJoin:
    """The steps of the join over one table of documents; every table it makes is written to the shared folder."""

    def __init__(self, docs: DataFrame, text: str, key: str, edits: int = EDITS, most_shared: int = MOST_SHARED) -> None:
        self.docs, self.text, self.key, self.edits, self.most_shared = docs, text, key, edits, most_shared
        lines = lines_of(only(docs, key, text), text, key).where(F.col("n") >= SHORTEST)
        self.places = written(lines.select("doc", "line_no", "n", *_hashes()), "places")
        groups = self.places.groupBy("a", "b").agg(
            F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n")
        )
        self.groups = written(groups, "groups")
        several = self.groups.where("copies > 1").select("a", "b", "first")
        repeated = split_join(self.places.select("doc", "line_no", "a", "b"), several, ["a", "b"])
        self.repeats = written(
            repeated.where("first.doc <> doc or first.line_no <> line_no").select("doc", "line_no", "a", F.col("first.doc").alias("keeps")),
            "repeats",
        )
        self.classes = written(self._named_classes(), "classes")
        self.placed = written(self._placed(self.classes), "placed")  # every place of a line that has a near one

    def _first_lines(self) -> DataFrame:
        """a, line, n of every different line that may have near ones, once each."""
        seen = self.repeats.groupBy("doc").agg(F.collect_set(_mark("line_no", "a")).alias("seen"))  # bounded by a document's lines
        docs = only(self.docs, self.key, self.text).toDF("doc", "text").where("doc is not null and text is not null")
        docs = docs.join(shipped(written(seen, "seen"), MOST_SHIPPED // 4), "doc", "left")
        lines = docs.select("seen", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
        lines = lines.select("seen", "line_no", F.btrim("raw", F.lit(" \t\r")).alias("line")).withColumn("n", F.char_length("line"))
        lines = lines.where(F.col("n") >= SHORTEST_NEAR).withColumn("a", F.xxhash64("line"))
        lines = lines.where(F.col("seen").isNull() | ~F.array_contains("seen", _mark("line_no", "a")))
        return lines.select("a", "line", "n")

    def _texts(self, shared: DataFrame) -> DataFrame:
        """a, line and its features, once for every line that looks up one of the entries."""
        lines = self._first_lines()
        if shared.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED:
            lines = entries(lines, self.edits).join(F.broadcast(shared), "entry", "left_semi")
        else:
            named = entries(lines, self.edits).select("entry", "a").join(shared, "entry", "left_semi").select("a").distinct()
            lines = lines.join(shipped(written(named, "named")), "a", "left_semi")
        lines = lines.select("a", "line", "n").dropDuplicates(["a"])
        line = F.col("line")
        return lines.select("a", "line", "n", sketch(line).alias("sketch"), pair_sketch(line).alias("pairs"), letter_counts(line).alias("letters"))

    def _members(self) -> tuple[DataFrame, DataFrame]:
        """The lines that share an entry (see :meth:`_texts`), and (entry, a, own, crowded, features) for every entry that they look up.

        An entry is shared if it is a line's own and is looked up again; it is crowded if more than ``most_shared`` lines own it.
        """
        counts = entries(self._first_lines(), self.edits).groupBy("entry").agg(F.sum(F.col("own").cast("int")).alias("owners"), F.count("*").alias("times"))
        counts = counts.where("owners > 0 and times > 1").select("entry", (F.col("owners") > self.most_shared).alias("crowded"))
        shared = written(counts, "shared")
        texts = written(self._texts(shared), "texts")
        members = entries(texts, self.edits).join(shipped(shared), "entry").select("entry", "a", "own", "crowded", *_FEATURES)
        members = written(members, "members")
        discard(shared)
        return texts, members

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of the pairs (a, c) those within ``edits`` edits, written."""
        pairs = pairs.where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct()
        left, right = texts.select("a", F.col("line").alias("x")), texts.select(F.col("a").alias("c"), F.col("line").alias("y"))
        checked = pairs.join(left, "a").join(right, "c")
        return written(checked.where(edit_distance(F.col("x"), F.col("y"), self.edits) <= self.edits).select("a", "c").distinct(), "near")

    def _classes(self) -> DataFrame:
        """(node, root): lines that links within ``edits`` edits connect.

        All pairs of lines that meet in an entry are compared, except where they are connected already.
        In crowded entries that takes rounds: everybody is compared with one line, then (among lines with like parts of sketches) with one
        line drawn from those outside the component of the first, and at last what is still apart, pair by pair.
        """
        self.texts, members = self._members()
        texts, near = self.texts, _near(self.edits)
        few, crowd = members.where("not crowded"), members.where("crowded")
        met = few.join(_other(few.where("own"), "entry"), "entry").where(near).select("a", "c")
        leader = crowd.where("own").groupBy("entry").agg(F.min(F.struct("a", *_FEATURES)).alias("f")).select("entry", "f.*")
        stars = crowd.join(_other(leader, "entry"), "entry").where(near).select("a", "c")
        links = self._verified(met.union(stars), texts)
        if not crowd.limit(1).count():
            discard(members)
            return smallest_reachable(links)
        roots = written(smallest_reachable(links), "classes")
        apart = written(self._apart(crowd.select("entry", "a", F.col("own").alias("indexed"), *_FEATURES), roots), "apart")
        discard(members)
        if not apart.limit(1).count():
            return roots
        dealt = told_apart(apart.drop("root", "least_root"), self.edits)
        for number in range(STARS):
            parts = self._apart(dealt, roots)
            outside = parts.where("indexed and root <> least_root")
            first = outside.groupBy("entry").agg(F.min(F.struct(F.xxhash64(F.lit(number), "a").alias("h"), "a", "root", *_FEATURES)).alias("f"))
            first = _other(first.select("entry", "f.*"), "entry", "root").withColumnRenamed("root", "root2")
            stars = parts.join(first, "entry").where((F.col("root") != F.col("root2")) & near)
            more = self._verified(stars.select("a", "c"), texts)
            if more.limit(1).count():
                links = links.union(more)
                roots = written(smallest_reachable(links), "classes")
        parts = self._apart(dealt, roots)
        other = _other(parts.where("indexed"), "entry", "root").withColumnRenamed("root", "root2")
        met_first = F.col("choice") == _first_choice(F.col("sketch").bitwiseXOR(F.col("sketch2")), self.edits)
        rest = parts.join(other, "entry").where((F.col("root") != F.col("root2")) & near & met_first)
        more = self._verified(rest.select("a", "c"), texts)
        if more.limit(1).count():
            roots = smallest_reachable(links.union(more))
        discard(apart)
        return roots

    def near_pairs(self) -> DataFrame:
        """(a, c): every two different lines within ``edits`` edits, once.

        They are in one class.  Lines of a class of up to ``most_shared`` are all compared, those of a larger one where two parts of their
        sketches agree; of a crowd there one side is cut into blocks of about ``BLOCK_LINES`` lines, so that several tasks share it.
        """
        lines = self.texts.join(shipped(self.classes.select("a", "size", F.col("rep").alias("entry"))), "a")
        few = lines.where(F.col("size") <= self.most_shared).withColumns({"choice": F.lit(-1), "block": F.lit(0), "blocks": F.lit(1)})
        many = told_apart(lines.where(F.col("size") > self.most_shared), self.edits)
        blocks = many.groupBy("entry").agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("blocks")).where("blocks > 1")
        many = many.join(shipped(written(blocks, "blocks")), "entry", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        lines = few.unionByName(many.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")))
        left = lines.select("entry", "choice", "block", "a", F.col("line").alias("x"), *_FEATURES)
        right = lines.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = _other(right, "entry", "choice", "block", "line").withColumnRenamed("line", "y")
        met_first = F.col("choice").isin(-1) | (F.col("choice") == _first_choice(F.col("sketch").bitwiseXOR(F.col("sketch2")), self.edits))
        within = F.when((F.col("a") < F.col("c")) & _near(self.edits) & met_first, edit_distance(F.col("x"), F.col("y"), self.edits) <= self.edits)
        return left.join(right, ["entry", "choice", "block"]).where(within).select("a", "c")

    def _apart(self, crowd: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of entries whose lines are not all connected, with their ``root`` and the entry's least one."""
        rows = crowd.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        entry = Window.partitionBy("entry")
        ends = {"least_root": F.min("root").over(entry), "most": F.max("root").over(entry), "some": F.max("indexed").over(entry)}
        return rows.withColumns(ends).where("least_root <> most and some").drop("most", "some")

    def _named_classes(self) -> DataFrame:
        """a, size, rep, rep_doc: the class of every line that has a near one; ``rep`` is its first line (by place) and ``rep_doc`` that line's document."""
        roots = written(self._classes(), "roots")
        first = self.groups.select(F.col("a").alias("node"), "first").join(shipped(roots), "node")
        reps = first.groupBy("root").agg(F.min(F.struct("first", "node")).alias("r"), F.count("*").alias("size"))
        reps = reps.select("root", "size", F.col("r.node").alias("rep"), F.col("r.first.doc").alias("rep_doc"))
        return split_join(roots, reps, ["root"]).select(F.col("node").alias("a"), "size", "rep", "rep_doc")

    def removals(self) -> DataFrame:
        """doc, line_no, a, keeps (the document whose line stays instead), near (false: an equal line stays)."""
        near = self.placed.where("a <> rep").select("doc", "line_no", "a", F.col("rep_doc").alias("keeps"), F.lit(True).alias("near"))
        all_ = self.repeats.select("doc", "line_no", "a", "keeps", F.lit(False).alias("near")).union(near)
        return all_.groupBy("doc", "line_no", "a").agg(F.min("keeps").alias("keeps"), F.max("near").alias("near"))

    def _placed(self, of: DataFrame) -> DataFrame:
        """Places of the lines that ``of`` names by ``a``, one row each there."""
        if of.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED:
            return self.places.join(F.broadcast(of), "a")
        return split_join(self.places, of, ["a"])

    def report(self) -> DataFrame:
        """One row per document: its lines, what is removed from it, its links to different lines, its class.

        A line has a link to every different line within ``edits`` edits of it; ``n_links`` adds up those of a document's
        lines, place by place.  Documents are in one class if, directly or not, one loses a line that the other keeps; ``class_id`` is the smallest id there.
        """
        degrees = self.near_pairs().select(F.explode(F.array("a", "c")).alias("a")).groupBy("a").agg(F.count("*").alias("links"))
        placed = self.placed.select("doc", "line_no", "a").distinct()
        links = split_join(placed, written(degrees, "links"), ["a"]).groupBy("doc").agg(F.sum("links").alias("n_links"))
        gone = written(self.removals(), "gone")
        removed = gone.groupBy("doc").agg(
            F.count("*").alias("n_removed"), F.sum(F.col("near").cast("long")).alias("n_near"),
            F.array_join(F.transform(F.sort_array(F.collect_list("line_no")), lambda i: i.cast("string")), ",").alias("removed"),
        )
        roots = smallest_reachable(gone.select(F.col("doc").alias("a"), F.col("keeps").alias("b")))
        links = links.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "full")
        key, text = F.col(f"`{self.key}`"), F.col(f"`{self.text}`")
        docs = self.docs.select(key.alias("doc"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
        docs = docs.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
        out = docs.join(removed, "doc", "left").join(links, "doc", "left")
        zero = F.lit(0).cast("long")
        return out.select(
            F.col("doc").alias(self.key), "n_lines", F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("n_near", zero).alias("n_near"), F.coalesce("n_links", zero).alias("n_links"),
            F.coalesce("root", "doc").alias("class_id"), F.coalesce("removed", F.lit("")).alias("removed"),
        )

    def cleaned(self) -> DataFrame:
        """The documents, all columns, without the removed lines."""
        removed = self.removals().groupBy("doc").agg(F.collect_set(_mark("line_no", "a")).alias("_removed")).withColumnRenamed("doc", "_doc")
        removed = shipped(written(removed, "removed"), MOST_SHIPPED // 4)
        out = self.docs.join(removed, self.docs[f"`{self.key}`"] == removed["_doc"], "left")
        kept = F.filter(
            F.split(F.col(f"`{self.text}`"), "\n", -1),
            lambda raw, i: ~F.array_contains("_removed", _mark(i, F.xxhash64(F.btrim(raw, F.lit(" \t\r"))))),
        )
        text = F.when(F.col("_removed").isNull(), F.col(f"`{self.text}`")).otherwise(F.array_join(kept, "\n"))
        return out.select(*[text.alias(c) if c == self.text else F.col(f"`{c}`") for c in self.docs.columns])
