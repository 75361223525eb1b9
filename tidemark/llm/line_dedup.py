"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's shingles are its windows of ``SHINGLE`` characters (UTF-16 units), one from every
character on, shorter at the line's end. One hash per shingle; the range of hashes is cut into
``BINS`` equal bins, and the least hash of each bin is the signature (one-permutation MinHash).
Windows are exploded, hashed and reduced within generated code; a hash so high that it is a bin's
least with a probability of about e^-8 is left out of that (not in lines that repeat themselves),
which spares most of the work on long lines and is the same for equal lines.

Two neighbouring minima, around the circle, are a band. The lines of a band are compared with its
smallest line; where that leaves several components, all others, matched or not, are compared
pair by pair if they are at most ``FEW``. Up to ``MANY`` are compared with one more line first, and
then whoever is in other components than most; a pair is made once, in the least band that both lines
have of these, however many they share. The lines of more crowded bands meet in regions instead,
those of their rarest windows, which bring together every linked pair among them (exact, see
``_regions``); lines that only share a passage do not meet there. Links merge components, and
pairs within one component are not compared again. Before texts are joined, pairs are ruled out by
sketches of the lines, which bound the windows that only one of two lines has (exact, see
``_possible``), so that lines that merely share a passage make no rows; for crowded bands the sketches
are of the different windows and tell more (``parities``).

A pair counts as a link only if the exact Jaccard index of the sets of all windows is at least
``threshold``. Union-find joins the links and one line per component stays: the first by
(doc_id, line number). Equal lines are one vertex: its id is the 64-bit hash of the line.
Expected recall of bands of two at an index of 0.75 is 98.8 %, at 0.85 99.9 %.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import drop_table, materialize

SHINGLE, BINS, FEW = 12, 8, 16
#: Bands of more lines meet in regions of their rarest windows. The sketches of a pair cost some 0.1 us, the windows of a
#: line some ms: about here both cost the same. Either way is exact.
MANY = 4096
#: Orders of lines by which regions choose their first line.
PIVOTS = 8
#: Longs of a line's sketch: a bit for each hash class of windows.
LONGS = 16
#: Longs of marks (see ``_marks``): 8 MB, of which a third is set for 25 million keys.
MARKS = 1 << 20
#: Hashes are kept up to this many a bin and line on average.
_DEPTH = 8
_NO_ID = -(1 << 63)
_BLANKS = " \t\r\f\v"
#: Places spread over a line (multiples of the golden ratio), as shares of its length.
_SHARES = [k * 0.6180339887498949 % 1 for k in range(16)]


def line_key(line: Column) -> Column:
    """What makes lines equal: their text without blanks at either end; empty ones get null and stay."""
    at_end = [f(line, F.lit(c)) for c in _BLANKS for f in (F.startswith, F.endswith)]
    # Trimming looks at every character, several times; few lines need it.
    trimmed = F.when(functools.reduce(Column.__or__, at_end), F.btrim(line, F.lit(_BLANKS))).otherwise(line)
    return F.nullif(trimmed, F.lit(""))


def coded(line: Column) -> Column:
    """The characters at two bytes each, so that a window is a slice of known place."""
    return F.encode(line, "UTF-16BE")


def window_at(code: Column, i: Column) -> Column:
    return F.xxhash64(code.substr(i, F.lit(2 * SHINGLE)))


def starts(code: Column) -> Column:
    return F.sequence(F.lit(1), F.length(code), F.lit(2))


def windows(code: Column) -> Column:
    """The hashes of all windows. As a lambda's variable ``code`` is not copied for each of them, as a column's bytes are."""
    return F.get(F.transform(F.array(code), lambda c: F.transform(starts(c), lambda i: window_at(c, i))), F.lit(0))


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, node): one row per line that is not blank."""
    split = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "raw"))
    return split.select("doc_id", "line_no", line_key(F.col("raw")).alias("line")).where(F.col("line").isNotNull()).withColumn("node", F.xxhash64("line"))


def signatures(rows: DataFrame) -> DataFrame:
    """(node, doc_id, n, minima) of every different line; ``doc_id`` holds the line (rows without id as the least one), ``n`` rows do."""
    code = rows.select("node", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), coded(F.col("line")).alias("code"))
    # Lines that repeat themselves have few different windows: if any of some places look alike, all hashes are kept.
    some = [window_at(F.col("code"), F.floor(F.length("code") / 2 * share).cast("int") * 2 + 1) for share in _SHARES]
    varied = F.size(F.array_distinct(F.array(*some))) == len(some)
    code = code.withColumn("n", F.when(varied, F.length("code") / 2).otherwise(1.0))
    each = code.select("node", "doc_id", "n", "code", F.explode(starts(F.col("code"))).alias("i"))
    h = each.select("node", "doc_id", "n", "i", window_at(F.col("code"), F.col("i")).alias("h"), _once())
    within = F.col("h").bitwiseAND(F.lit((1 << 61) - 1)).cast("double")
    low = h.where((within * F.col("n") <= F.lit(float(_DEPTH * BINS << 61))) | (F.col("i") == 1)).where("p >= 0")
    least = [F.min(F.when(F.shiftrightunsigned("h", 61) == k, F.col("h"))).alias(f"m{k}") for k in range(BINS)]
    found = low.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.when(F.col("i") == 1, 1)).alias("rows"), *least)
    return found.select("node", "doc_id", F.col("rows").alias("n"), F.array_compact(F.array(*[f"m{k}" for k in range(BINS)])).alias("minima"))


def _once() -> Column:
    """A column ``p`` that keeps a filter by it, ``p >= 0``, above the columns beside it: it is not deterministic, and Spark would
    otherwise put what makes these columns into the filter, and so make them anew for each mention and for each row that stays."""
    return F.spark_partition_id().alias("p")


def _place(key: Column, longs: int) -> tuple[Column, Column]:
    """The long of ``longs`` and the bit in it that stand for a hash ``key``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(key, 65 - longs.bit_length()).cast("int"), bit


def _marks(keys: DataFrame, name: str, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row with the array ``name``, a bit set for each of ``n`` hashes (``key``), and how to ask it: no key is missed, while
    of others about one in 16 passes, or more where ``MARKS`` bounds the array. Joins with so few keys need not move all rows."""
    longs = 1 << min(MARKS.bit_length() - 1, max(6, (n // 4).bit_length()))
    at, bit = _place(F.col("key"), longs)
    held = keys.select(at.alias("at"), bit.alias("bit")).union(keys.sparkSession.range(longs).select(F.col("id").cast("int"), F.lit(0).cast("long")))
    each = held.groupBy("at").agg(F.bit_or("bit").alias("bit"))
    row = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"]).alias(name))

    def asked(key: Column) -> Column:
        at, bit = _place(key, longs)
        return F.get(name, at).bitwiseAND(bit) != 0

    return row, asked


def _band() -> Column:
    """The band at place ``pos``: two minima from there, around the circle."""
    return F.xxhash64(F.get("minima", F.col("pos")), F.get("minima", (F.col("pos") + 1) % F.size("minima")))


def _classes(each: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """(node, most, held) of windows (node, s): how many, and for each of 64 * LONGS hash classes what ``fold`` makes of its bits."""
    long, bit = F.shiftrightunsigned("s", 64 - LONGS.bit_length() + 1), F.expr("shiftleft(1L, cast(s & 63 AS INT))")
    found = each.groupBy("node").agg(F.count("*").cast("int").alias("most"), *[fold(F.when(long == k, bit)).alias(f"h{k}") for k in range(LONGS)])
    return found.select("node", "most", F.array(*[F.coalesce(f"h{k}", F.lit(0).cast("long")) for k in range(LONGS)]).alias("held"))


def sketches(codes: DataFrame) -> DataFrame:
    """(node, most, held): how many windows (equal ones too), and a bit for each of 64 * LONGS hash classes that has one."""
    each = codes.select("node", "code", F.explode(starts(F.col("code"))).alias("i"))
    return _classes(each.select("node", window_at(F.col("code"), F.col("i")).alias("s")), F.bit_or)


def parities(own: DataFrame) -> DataFrame:
    """(node, most, held) of *different* windows (node, s): a class's bit tells whether it has an odd number of them.

    A class whose bits differ has a window that only one of two lines has. Two windows that only one has hide each other
    where they share a class, but, unlike in ``sketches``, the many windows that both lines have hide none.
    """
    return _classes(own, F.bit_xor)


def _apart() -> Column:
    """In how many classes the sketches ``held`` and ``cheld`` differ."""
    differ = [F.bit_count(F.get("held", F.lit(k)).bitwiseXOR(F.get("cheld", F.lit(k)))) for k in range(LONGS)]
    return sum(differ[1:], differ[0])


def _possible(threshold: float) -> Column:
    """Whether the sketches (most, held) and (cmost, cheld) allow a link: a class that one line has and the other lacks is a
    window that only one has, and linked lines have (1 - threshold) / (1 + threshold) of their sizes of those at most."""
    return (1 + threshold) * _apart() <= (1 - threshold) * (F.col("most") + F.col("cmost")) + 1e-6


def _matching(pairs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """The (node, centre) ``pairs`` of index >= ``threshold``; ``codes``: (node, code). Pairs are read twice.

    Pairs may come with ``total``, the different windows of one line and those of the other, or null. Without, these are only
    counted where it matters: all windows, equal ones too, are no fewer. The windows of a centre are made once, however many
    pairs it is in.
    """
    total = F.col("total") if "total" in pairs.columns else F.lit(None).cast("int")
    second = codes.join(pairs.select(F.col("centre").alias("node")), "node", "left_semi").select(F.col("node").alias("centre"), windows(F.col("code")).alias("s2"))
    first = pairs.select("node", "centre", total.alias("total")).alias("p").join(codes.alias("c"), F.col("p.node") == F.col("c.node")).select("p.*", "c.code")
    made = first.join(second, "centre").select("node", "centre", "total", windows(F.col("code")).alias("s1"), "s2", _once())
    both = made.where("p >= 0").select("node", "centre", "total", "s1", "s2", F.size(F.array_intersect("s1", "s2")).alias("both"), _once())
    share, most = (1 + threshold) * F.col("both"), F.size("s1") + F.size("s2")
    different = F.size(F.array_distinct("s1")) + F.size(F.array_distinct("s2"))
    enough = share >= threshold * F.coalesce("total", F.when(share >= threshold * most, most).otherwise(different))
    return both.where(enough).where("p >= 0").select("node", "centre")


def _edges(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("id").alias("node"), F.col("component").alias("centre"))


def _open(members: DataFrame, key: str, *more: Column) -> DataFrame:
    """``members`` of the groups by ``key`` that lie in several components ``c``, with ``n_in``, the group's size, and ``more`` of the group."""
    several = members.groupBy(key).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n_in"), *more).where("lo < hi")
    return members.join(several.drop("lo", "hi"), key)


def _named(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``nodes`` with ``c``, their components. One row a line is joined; its bands or regions are exploded after that."""
    return nodes.join(comp.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _different(codes: DataFrame) -> DataFrame:
    """(node, all): the different windows of every line."""
    return codes.select("node", F.array_distinct(windows(F.col("code"))).alias("all"))


def _regions(nodes: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """(node, size, groups): the first windows (s, place) of every line, rare ones first, that a partner cannot all lack.

    A line of n different windows shares at least threshold * n of them with any line it is linked
    to, so the first that two linked lines share is among the first n - ceil(threshold * n) + 1 of both.
    """
    own = materialize(_different(codes.join(nodes, "node", "left_semi")).select("node", F.size("all").alias("size"), F.explode("all").alias("s")), "line-windows")
    shared = own.groupBy("s").agg(F.count("*").cast("int").alias("m")).where("m > 1")
    ordered = own.join(shared, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("o"))
    # Windows that no other line has come first; they are counted, not kept.
    alone = F.col("size") - F.size("o")
    first = F.slice("o", F.lit(1), F.greatest(F.lit(0), F.col("size") - F.ceil(threshold * F.col("size") - 1e-9).cast("int") + 1 - alone))
    groups = F.transform(first, lambda w, i: F.struct(w["s"].alias("s"), (alone + i).alias("place")))
    out = materialize(ordered.select("node", "size", groups.alias("groups")), "line-regions")
    drop_table(nodes.sparkSession, own)
    return out


def _groups(crowded: DataFrame, codes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, size, groups, bands): in which groups (s, place) the lines of the bands ``crowded`` meet; ``parities``; and their ``codes``.

    Groups are the bands themselves, from the first window on (place 0), also in ``bands``, and regions for bands of more
    than ``MANY``, without ``bands``.
    """
    own = materialize(codes.join(crowded.select("node").distinct(), "node", "left_semi"), "line-crowd")
    parity = materialize(parities(_different(own).select("node", F.explode("all").alias("s"))), "line-parities")
    bands = crowded.where(F.col("n_in") <= MANY).groupBy("node").agg(F.collect_set("band").alias("bands")).join(parity, "node")
    group = F.transform("bands", lambda b: F.struct(b.alias("s"), F.lit(0).alias("place")))
    out = materialize(bands.select("node", F.col("most").alias("size"), group.alias("groups"), "bands"), "line-groups")
    more = crowded.where(F.col("n_in") > MANY).select("node").distinct()
    return (out if more.isEmpty() else out.unionByName(_regions(more, own, threshold), allowMissingColumns=True)), parity, own


def _ends() -> list[Column]:
    return [F.greatest("node", "centre").alias("node"), F.least("node", "centre").alias("centre")]


def _outside(named: DataFrame, allowed: Column) -> DataFrame:
    """(node, centre, total): the ``allowed`` pairs of a group's different components, of which one line at least is not in its largest.

    A pair is made from one end, and in the least of the ``bands`` that both lines have, which holds both components
    as well. Regions have none; there a pair comes in each.
    """
    counts = named.groupBy("s", "c").agg(F.count("*").alias("n"))
    largest = counts.groupBy("s").agg(F.max(F.struct("n", "c")).alias("b")).select("s", F.col("b.c").alias("big"))
    sides = [F.col(c).alias(f"c{c}") for c in ("size", "place", "bands", "c", "most", "held")]
    outside = named.join(largest, "s").where("c <> big").select("s", "big", F.col("node").alias("centre"), *sides)
    one_end = (F.col("c") == F.col("big")) | (F.col("node") > F.col("centre"))
    least = F.coalesce(F.array_min(F.array_intersect("bands", "cbands")) == F.col("s"), F.lit(True))
    pairs = named.join(outside, "s").where("c <> cc").where(one_end & allowed & least)
    return pairs.select(*_ends(), (F.col("size") + F.col("csize")).alias("total"))


def links(rows: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v): node pairs with the components of the links of exact index >= ``threshold`` among what the bands bring together;
    (node) of the lines that several ``rows`` hold; and (doc_id, line_no, node) of the rows with lines of either, and some others."""
    spark = rows.sparkSession
    once = materialize(signatures(rows), "line-vertices")
    places = once.select("node", "minima", F.explode(F.sequence(F.lit(0), F.size("minima") - 1)).alias("pos"))
    banded = places.select("node", _band().alias("band"))
    # Written before it is joined, so that the join on a hot band can be split.
    star = materialize(banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "line-stars")
    marks, shared = _marks(star.select(F.col("band").alias("key")), "shared", star.count())
    likely = banded.crossJoin(F.broadcast(marks)).where(shared(F.col("band"))).select("node", "band")
    member = materialize(likely.join(star.hint("shuffle_hash"), "band").distinct(), "line-bands")
    drop_table(spark, star)

    # The lines in such bands, from one document that holds the line.
    wanted = materialize(once.join(member.select("node").distinct(), "node", "left_semi").select("node", "doc_id"), "line-wanted")
    repeated = materialize(once.where("n > 1").select("node"), "line-repeated")
    drop_table(spark, once)
    # The documents are split once more, for the texts of the former and the places of both.
    of = F.coalesce("doc_id", F.lit(_NO_ID))
    place = F.xxhash64("node", of)
    some = wanted.select("node").union(repeated)
    nodes, kept = _marks(some.select(F.col("node").alias("key")), "nodes", some.count())
    places, told = _marks(wanted.select(F.xxhash64("node", "doc_id").alias("key")), "places", wanted.count())
    marked = rows.crossJoin(F.broadcast(nodes.crossJoin(places))).where(kept(F.col("node")))
    seen = materialize(marked.select("doc_id", "line_no", "node", F.when(told(place), F.col("line")).alias("line")), "line-seen")
    texts = seen.where(F.col("line").isNotNull()).withColumn("doc_id", of).join(wanted.hint("shuffle_hash"), ["node", "doc_id"], "left_semi")
    codes = materialize(texts.select("node", "line").dropDuplicates(["node"]).select("node", coded(F.col("line")).alias("code")), "line-codes")
    drop_table(spark, wanted)
    sketch = materialize(sketches(codes), "line-sketches")
    side = sketch.select(F.col("node").alias("centre"), F.col("most").alias("cmost"), F.col("held").alias("cheld"))
    able = _possible(threshold)

    spokes = member.where("node > centre").groupBy("node").agg(F.collect_set("centre").alias("centres")).join(sketch, "node")  # a few a line
    spokes = spokes.select("node", "most", "held", F.explode("centres").alias("centre")).join(side, "centre").where(able).select("node", "centre")
    spokes = materialize(spokes, "line-pairs")
    good = materialize(_matching(spokes, codes, threshold), "line-links")
    comp = components(good, "node", "centre", label="line-components")

    # Lines that match the centre stay, as others may only match them; pairs with the centre are done.
    bands = _named(member.where("n > 2 AND node > centre").groupBy("node").agg(F.collect_set("band").alias("bands")), comp)
    rest = materialize(_open(bands.select("node", "c", F.explode("bands").alias("band")), "band"), "line-rest")
    drop_table(spark, member)
    few = rest.where(F.col("n_in") <= FEW).groupBy("node", "c").agg(F.collect_set("band").alias("bands")).join(sketch, "node")
    few = few.select("node", "c", "most", "held", F.explode("bands").alias("band"))
    other = few.select("band", F.col("node").alias("centre"), F.col("c").alias("cc"), F.col("most").alias("cmost"), F.col("held").alias("cheld"))
    pairs = few.join(other, "band").where("node > centre AND c <> cc").where(able).select("node", "centre")
    groups, parity, own = _groups(rest.where(F.col("n_in") > FEW), codes, threshold)
    cparity = parity.select(F.col("node").alias("centre"), F.col("most").alias("cmost"), F.col("held").alias("cheld"))
    # Of what is left from the window at ``place`` on, linked lines share enough.
    enough = (1 + threshold) * F.least(F.col("size") - F.col("place"), F.col("csize") - F.col("cplace")) >= threshold * (F.col("size") + F.col("csize")) - 1e-6

    def members(*more: Column) -> DataFrame:
        """The members (s, node, size, place, bands, c) of the groups that lie in several components, and ``more``."""
        each = _named(groups, comp).select("node", "size", "bands", "c", F.explode("groups").alias("g"))
        return _open(each.select("g.s", "node", "size", "g.place", "bands", "c"), "s", *more)

    # In each group one line is compared with all, then whoever is in none of the group's large component. Groups have one
    # of PIVOTS orders of lines, so that a line meets few first ones in its many groups, and its pairs are made once.
    rank = F.xxhash64("node", F.col("s").bitwiseAND(F.lit(PIVOTS - 1)))
    pivot = F.min(F.struct(rank.alias("k"), F.col("node").alias("centre"), F.col("size").alias("csize"), F.col("place").alias("cplace"), F.col("c").alias("cc"))).alias("p")
    hung = members(pivot).select("node", "size", "place", "c", "p.*").where("c <> cc").where(enough).select("node", "centre").distinct()
    hung = hung.join(parity, "node").join(cparity, "centre").where(able).select(*_ends(), (F.col("most") + F.col("cmost")).alias("total"))
    pairs = pairs.withColumn("total", F.lit(None).cast("int")).union(hung).groupBy("node", "centre").agg(F.max("total").alias("total"))
    pairs = materialize(pairs, "line-pairs")
    more = materialize(_matching(pairs, codes, threshold), "line-links")
    comp = components(_edges(comp).union(more), "node", "centre", label="line-components")  # from stars on: few rounds

    named = materialize(members().drop("n_in").join(parity, "node"), "line-open")
    outside = materialize(_outside(named, enough & able).distinct(), "line-pairs")
    last = materialize(_matching(outside, own, threshold), "line-links")
    drop_table(spark, codes, own, sketch, parity, rest, groups, named, spokes, pairs, outside)
    return _edges(comp).union(last).select(F.col("node").alias("u"), F.col("centre").alias("v")), repeated, seen.select("doc_id", "line_no", "node")


def removed_lines(documents: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, keeper_doc, keeper_line) of every line that a like line before it makes redundant.

    Blank lines are never redundant. Rows that share an id count as parts of one document; of
    lines at one place the tie goes either way, as they have one number. Rows without id sort first.
    """
    spark = documents.sparkSession
    rows = lines(documents, id_col, text_col)
    edges, repeated, seen = links(rows, threshold)
    comp = components(edges, label="line-components").select(F.col("id").alias("node"), F.col("component").alias("c"))
    # Only lines of classes of several are looked at again.
    named = comp.union(repeated.join(comp, "node", "left_anti").select("node", F.col("node").alias("c")))
    alike = materialize(seen.join(named, "node").select("doc_id", "line_no", "c"), "line-alike")
    keepers = alike.groupBy("c").agg(F.min(F.struct("doc_id", "line_no")).alias("keeper"))
    drop_table(spark, repeated, seen)
    return alike.join(keepers, "c").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keeper"))).select(
        "doc_id", "line_no", F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.line_no").alias("keeper_line")
    )


def dedup_lines(documents: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with redundant lines taken out of the text; every row and column stays.

    A text of which no line is redundant stays as it is, null stays null; where all lines go, the text is empty.
    """
    gone = removed_lines(documents, threshold, id_col, text_col).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    text, numbers = documents[text_col], gone["_gone"]
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(numbers, i)), "\n")
    out = documents.join(gone, documents[id_col].cast("long").eqNullSafe(gone["_id"]), "left")
    return out.select(*[F.when(numbers.isNull(), text).otherwise(kept).alias(c) if c == text_col else documents[c] for c in documents.columns])
