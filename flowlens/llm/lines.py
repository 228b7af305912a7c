"""Operator 6 [native]: lines that repeat or nearly repeat across documents, found by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import computed_once, discard, materialize, packed, unpacked, with_row_keys

#: Most edits between two linked lines, and the characters of the longer line for each: one edit from 5 characters on, two from 10.
MOST_EDITS, CHARS_PER_EDIT = 2, 5
#: Members of a group up to which they are compared with each other at once; larger groups are cut finer instead.
DIRECT = 256
BLANK = r"^[\x20\x09-\x0D]*$"
#: Place of documents without an id in the order of documents: after all others.
LAST = (1 << 63) - 1
#: What a member of a group is: a segment at its own place, a probe for it at another place or for a shorter line, or a segment that only
#: longer lines may link with, as they may have one edit more than lines of its length.
SEGMENT, PROBE, INDEX = 0, 1, 2


def dedup_lines(docs: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row of ``docs``.

    A line is what stands between line feeds and has a word; blank lines stay
    and aren't counted. Lines link at ``most_edits`` (1 to 3) or fewer edits of
    characters (code points), if those are at most a fifth of the longer line. Of
    equal lines the first one stays, by doc_id and place. All occurrences of a
    line go if a linked line first occurs at an earlier place. Null texts have no
    lines and a null kept_text; null ids come after all others; rows with equal
    ids count as one document. Other columns are not read. An empty table gives
    no rows.

    Distinct lines are found by a 128-bit hash with partial sums before the
    shuffle, so a line in every document is one row. A line within k edits of
    another shares one of k + 1 segments with it, at nearly the same place: those
    segments are the index, substrings at the places that a pair of lengths
    allows are the probes, and both meet by hash. Only the lines that met have
    their texts fetched; ``_losers`` then compares them without making all pairs.
    """
    if not 1 <= most_edits <= 3:
        raise ValueError("most_edits must be 1, 2 or 3")
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("ord"), F.xxhash64("text").alias("th"))
    lines = _lines(docs)
    distinct = materialize(_distinct(lines, most_edits), "lines")
    members = _members(distinct, most_edits)
    texts = _texts(docs, distinct, members)
    losers = _losers(texts, _groups(members, texts, most_edits), most_edits)
    flagged = distinct.where("n_docs > 1").select("h1", "h2", "first_doc").withColumn("near", F.lit(False)).unionByName(losers.withColumn("first_doc", F.lit(-LAST)).withColumn("near", F.lit(True)))
    gone = lines.select("ord", "th", "at", "h1", "h2").join(flagged, ["h1", "h2"]).where("near or ord > first_doc").groupBy("ord", "th").agg(F.collect_set("at").alias("gone"))
    rows = docs.join(gone, ["ord", "th"], "left").select("doc_id", "text", F.split("text", "\n").alias("_all"), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("_gone"))
    rows = rows.select("doc_id", "text", "_all", "_gone", _marked("text").alias("_marked"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_marked") - 1), "_gone"), lambda i: F.get("_marked", i))
    rows = rows.select("doc_id", "text", "_all", F.when(F.size("_marked") > 0, kept).alias("_kept"))
    n_lines = F.size(F.filter("_all", lambda s: ~s.rlike(BLANK)))
    n_kept = F.size(F.filter("_kept", lambda s: ~F.startswith(s, F.lit("\n"))))
    plain = F.transform("_kept", lambda s: F.when(F.startswith(s, F.lit("\n")), F.substring_index(s, "\n", -1)).otherwise(s))
    done = computed_once(
        rows.select("doc_id", "text", "_all", "_kept"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - n_kept).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join(plain, "\n")).alias("kept_text"),
    )
    return done.select("doc_id", "n_lines", "n_removed", "kept_text")


def without_repeated_lines(docs: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_chars``, if there, counted again.

    Documents all of whose lines went are dropped; documents that had none stay.
    Every row is a document of its own, in order of doc_id, nulls last: of rows
    that repeat an id and a text one stays, as the lines of the others repeat.
    """
    own = ("doc_id", "text", "n_chars")
    keyed = with_row_keys(packed(docs, own), "_row")
    done = dedup_lines(keyed.select(F.col("_row").alias("doc_id"), "text"), most_edits).where("n_removed < n_lines or n_lines = 0").select(F.col("doc_id").alias("_row"), F.col("kept_text").alias("text"))
    kept = keyed.drop("text", "n_chars").join(done, "_row")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(kept, docs, own)


def _marked(text: str) -> Column:
    """Lines of a text in order, each once; blank ones, told apart by a line feed and their place, all stay."""
    mark = F.transform(F.split(text, "\n"), lambda s, i: F.when(s.rlike(BLANK), F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), s)).otherwise(s))
    return F.array_distinct(mark)


def _lines(docs: DataFrame) -> DataFrame:
    """ord, th (hash of the text), at (place among the marked lines), line, h1, h2 of every line of a document, equal ones once."""
    rows = docs.where("text is not null").select("ord", "th", F.posexplode(_marked("text")).alias("at", "line")).where(~F.startswith("line", F.lit("\n")))
    return rows.withColumn("h1", F.xxhash64(F.lit(1), "line")).withColumn("h2", F.xxhash64(F.lit(2), "line"))


def _segment(length: Column, i: Column | int, parts: Column) -> tuple[Column, Column]:
    """Where segment ``i`` of ``parts`` of a string of ``length`` characters begins, from 0, and its length; later segments are the longer ones."""
    i = F.lit(i) if isinstance(i, int) else i
    size, longer = F.floor(length / parts).cast("int"), parts - length % parts
    return size * i + F.greatest(F.lit(0), i - longer), size + F.when(i >= longer, 1).otherwise(0)


def _shifts(most_edits: int) -> list[tuple[int, int]]:
    """(segment, shift of its place) of every child of a group."""
    return [(i, s) for i in range(most_edits + 1) for s in range(-i, i + 1)]


def _keys(most_edits: int) -> list[tuple[int, int, int, int]]:
    """(what it is, difference of lengths, segment, shift) of every key of a line.

    Of k edits at most i lie before the first segment i that none of them touch
    and at most k - i behind it, which bounds the shifts. The longer line says
    how many edits there may be, so a line is cut a second time where a longer
    partner may have one edit more than lines of its own length.
    """
    k = most_edits
    return [(role, 0, i, 0) for role in (SEGMENT, INDEX) for i in range(k + 1)] + [(PROBE, d, i, s) for d in range(k + 1) for i, s in _shifts(k) if abs(d - s) <= k - i and (d or s)]


def _edits(length: Column, most_edits: int) -> Column:
    return sum((F.when(length >= CHARS_PER_EDIT * e, 1).otherwise(0) for e in range(1, most_edits + 1)), F.lit(0))


def _distinct(lines: DataFrame, most_edits: int) -> DataFrame:
    """One row for each line: h1, h2, first_doc, n_docs and the keys in the order of ``_keys``, null where there is none."""
    rows = lines.select("ord", "h1", "h2", "line", F.length("line").alias("n")).withColumn("e", _edits(F.col("n"), most_edits))
    keys = []
    for role, d, i, s in _keys(most_edits):
        e, n = F.col("e") + int(role == INDEX), F.col("n") - d
        start, size = _segment(n, i, e + 1)
        fits = (e >= max(1, d, i)) & (abs(d - s) <= e - i)
        if role == INDEX:
            fits &= _edits(n + e, most_edits) == e
        keys.append(F.when(fits & (start + s >= 0) & (start + s + size <= F.col("n")), F.xxhash64(e, n, F.lit(i), F.substring("line", start + s + 1, size))))
    return rows.select("ord", "h1", "h2", F.array(*keys).alias("keys")).groupBy("h1", "h2", "keys").agg(F.min("ord").alias("first_doc"), F.count("*").alias("n_docs"))


def _members(distinct: DataFrame, most_edits: int) -> DataFrame:
    """g, h1, pos: the keys at which a line meets another, whose key it is by its place in ``_keys``.

    The index has one row for each key while the probes meet it, so the join
    makes no more rows than there are probes, and hot keys can be split.
    """
    own = 2 * (most_edits + 1)
    index = distinct.select("h1", F.posexplode(F.slice("keys", 1, own)).alias("pos", "g")).where("g is not null")
    probes = distinct.select("h1", F.posexplode(F.slice("keys", own + 1, len(_keys(most_edits)) - own)).alias("pos", "g")).where("g is not null").withColumn("pos", F.col("pos") + own)
    # most keys have one line, so the second one is null where it is the first
    seen = materialize(index.groupBy("g").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).select("g", "low", F.nullif("high", "low").alias("high")), "index")
    met = materialize(probes.join(seen.hint("merge"), "g").where("low <> h1 or high is not null").select("g", "h1", "pos"), "probes")
    keys = met.select("g").union(seen.where("high is not null").select("g")).distinct()
    members = materialize(met.unionByName(index.join(keys, "g", "left_semi").select("g", "h1", "pos")), "members")
    discard(seen)
    discard(met)
    return members


def _texts(docs: DataFrame, distinct: DataFrame, members: DataFrame) -> DataFrame:
    """id, h1, h2, line of the lines that met another; ids rise with the first place of a line."""
    needed = distinct.select("h1", "h2", F.col("first_doc").alias("ord")).join(members.select("h1").distinct(), "h1", "left_semi")
    # the ids needed grow with the table, so the plan is the same at every size and never broadcasts them
    held = docs.where("text is not null").join(needed.select("ord").distinct().hint("merge"), "ord", "left_semi")
    first = _lines(held).join(needed, ["ord", "h1", "h2"], "left_semi").groupBy("ord", "h1", "h2", "line").agg(F.min("at").alias("at"))
    order = ["ord", "at", "line"]
    return materialize(first.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "line"), "texts")


def _groups(members: DataFrame, texts: DataFrame, most_edits: int) -> DataFrame:
    """g, id, role, free of every member: ``free`` are the parts of the line before and behind the segment.

    Each part has the member's own string t, the length l that it has in the
    line of the index, and e, the edits that may lie in it; equal parts go.
    """
    keys = _keys(most_edits)
    of = lambda x: F.get(F.array(*[F.lit(k[x]) for k in keys]), F.col("pos"))
    rows = members.join(texts.select("id", "h1", "line"), "h1").select("g", "id", "line", of(0).alias("role"), (F.length("line") - of(1)).alias("l"), of(2).alias("i"), of(3).alias("s"))
    rows = rows.withColumn("e", _edits(F.length("line"), most_edits) + F.when(F.col("role") == INDEX, 1).otherwise(0))
    return rows.select("g", "id", "role", _around(F.col("line"), F.col("l"), F.col("e"), F.col("i"), F.col("s")).alias("free"))


def _around(t: Column, length: Column, e: Column, i: Column, s: Column) -> Column:
    """The parts of ``t`` before and behind segment ``i`` shifted by ``s``, without those that have no edits left."""
    start, size = _segment(length, i, e + 1)
    part = lambda text, n, edits: F.struct(text.alias("t"), n.cast("int").alias("l"), edits.cast("int").alias("e"))
    behind = F.substring(t, start + s + size + 1, F.length(t))
    return F.filter(F.array(part(F.substring(t, F.lit(1), start + s), start, i), part(behind, length - start - size, e - i)), lambda x: x["e"] > 0)


def _finer(rows: DataFrame, most_edits: int) -> DataFrame:
    """The groups of ``rows`` cut again: the longest part is split into one segment more than it may have edits, as whole lines are."""
    longest = F.array_max(F.transform("free", lambda p, k: F.struct(F.when(p["l"] > p["e"], p["l"]).otherwise(0).alias("l"), (-k).alias("k"))))
    rows = computed_once(rows, (-longest["k"]).alias("k"))
    rows = computed_once(rows, F.get("free", F.col("k")).alias("p"))
    t, n, e = (F.col(c) for c in ("p.t", "p.l", "p.e"))
    fits = []
    for i, s in _shifts(most_edits):
        start, size = _segment(n, i, e + 1)
        fits.append(F.when(((F.col("role") != INDEX) | F.lit(s == 0)) & (i <= e) & (F.abs(F.length(t) - n - s) <= e - i) & (start + s >= 0) & (start + s + size <= F.length(t)), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"))))
    rows = rows.select("g", "id", "role", "free", "k", "p", F.explode(F.array_compact(F.array(*fits))).alias("c"))
    i, s = F.col("c.i"), F.col("c.s")
    start, size = _segment(n, i, e + 1)
    free = F.concat(F.slice("free", F.lit(1), F.col("k")), _around(t, n, e, i, s), F.slice("free", F.col("k") + 2, F.size("free")))
    role = F.when(s == 0, F.col("role")).otherwise(PROBE)
    return rows.select(F.xxhash64("g", i, F.substring(t, start + s + 1, size)).alias("g"), "id", role.alias("role"), free.alias("free"))


def _losers(texts: DataFrame, rows: DataFrame, most_edits: int) -> DataFrame:
    """h1, h2 of the lines that go because of a linked earlier one.

    A round compares each member of a group with the group's first member only,
    which settles all that link with it, and with all others where they are few.
    What stays open in a larger group, and the earlier members that could still
    settle it, goes to finer groups, which share another segment of what is left
    of their lines. Parts that are no longer than their edits aren't cut: all
    their strings are that short, and such groups are compared as they are. No
    link is lost, as every pair that links shares a finer group too.
    """
    lost, gone = None, []
    while True:
        rows = materialize(rows, "groups")
        first = lambda of: F.min_by(F.struct("id", "free"), F.when(of, F.col("id")))
        heads = rows.groupBy("g").agg(first(F.col("role") != PROBE).alias("i"), first(F.col("role") != INDEX).alias("p"), F.count("*").alias("n"))
        few = (F.col("n") <= DIRECT) | ~F.exists("free", lambda x: x["l"] > x["e"])
        met = rows.join(heads, "g").where("i is not null and p is not null and n > 1").select("g", "id", "role", "free", F.when(F.col("role") == PROBE, F.col("i")).otherwise(F.col("p")).alias("head"), F.when(~few, F.col("p.free")).alias("first"), few.alias("few"))
        met = materialize(met.select("g", "id", "role", "free", "first", "few", F.col("head.id").alias("head"), ((F.col("head.id") < F.col("id")) & _near(F.col("head.free"), F.col("free"), most_edits)).alias("near")), "met")
        a = met.where("few").select("g", F.col("id").alias("a"), F.col("role").alias("r"), F.col("free").alias("free_a"))
        b = met.where("few and head < id and not near")
        apart = (F.col("a") < F.col("id")) & (F.col("a") != F.col("head")) & ((F.col("r") == SEGMENT) | (F.col("r") != F.col("role"))) & _near(F.col("free_a"), F.col("free"), most_edits)
        new = materialize(met.where("near").select("id").union(b.join(a, (b["g"] == a["g"]) & apart, "left_semi").select("id")).distinct(), "near_lines")
        lost = new if lost is None else lost.unionByName(new)
        still = materialize(met.where("head < id and not few and not near").join(lost, "id", "left_anti").groupBy("g").agg(F.max("id").alias("most")), "open")
        gone += [rows, met, still]
        if still.isEmpty():
            break
        kept = materialize(met.where("not few").join(still, "g").where("id <= most").select("g", "id", "role", "free", "first"), "kept")
        rows = _finer(_narrowed(kept, most_edits), most_edits)
        gone.append(kept)
    out = materialize(texts.join(lost, "id", "left_semi").select("h1", "h2").distinct(), "losers")
    for table in gone:
        discard(table)
    return out


def _near(a: Column, b: Column, most_edits: int) -> Column:
    """Whether each part of a member is within its edits of the same part of another member of the group."""
    return F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: _distance_within(x["a"]["t"], x["b"]["t"], x["a"]["e"], most_edits))


def _narrowed(rows: DataFrame, most_edits: int) -> DataFrame:
    """The same groups without what all their members share at the ends of a part, and of groups with equal members and parts only one.

    Edits need not lie in what all members share; so the parts shrink to where
    the members differ, and groups that were formed by different segments become
    equal. ``first`` has the parts of the group's first member.
    """
    shared = F.transform(F.arrays_zip("free", "first"), lambda x: _shared(x["free"]["t"], x["first"]["t"]))
    held = rows.select("g", shared.alias("x"))
    ends = held.groupBy("g").agg(*[F.min(F.get("x", F.lit(j))[c]).alias(f"{c}{j}") for j in range(most_edits) for c in ("begin", "end")])
    begin, end = (F.array(*[F.col(f"{c}{j}") for j in range(most_edits)]) for c in ("begin", "end"))

    def cut(p: Column, j: Column) -> Column:
        b, off = F.get(begin, j), F.get(begin, j) + F.get(end, j)
        return F.struct(F.substring(p["t"], b + 1, F.length(p["t"]) - off).alias("t"), (p["l"] - off).alias("l"), p["e"].alias("e"))

    free = F.filter(F.transform("free", cut), lambda p: (p["l"] > 0) | (p["t"] != ""))
    rows = materialize(rows.join(ends, "g").select("g", "id", "role", free.alias("free")), "narrow")
    one = F.size("free") == 1
    same = [F.xxhash64(F.lit(s), "id", "role", F.transform("free", lambda p: p["t"]), F.when(one, F.lit(None)).otherwise(F.transform("free", lambda p: p["e"]))) for s in (1, 2)]
    signs = rows.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(same[0]).alias("x1"), F.bit_xor(same[1]).alias("x2"), F.max(F.get("free", F.lit(0))["e"]).alias("e"))
    kept = signs.groupBy("n", "x1", "x2").agg(F.max_by("g", F.struct("e", "g")).alias("g"))
    return rows.join(kept.select("g"), "g", "left_semi")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _common(x: Column, y: Column, most: Column, behind: bool) -> Column:
    """Length of the common beginning or end of two strings, up to ``most``, by halving."""

    def longer(n: Column, step: Column) -> Column:
        piece = lambda s: F.substring(s, F.length(s) - n - step + 1 if behind else n + 1, step)
        return n + F.when(n + step <= most, F.when(piece(x) == piece(y), step).otherwise(0)).otherwise(0)

    return F.aggregate(F.array(*[F.lit(1 << p) for p in range(24, -1, -1)]), F.lit(0), longer)


def _shared(x: Column, y: Column) -> Column:
    """How many characters two strings have in common at their beginnings and, of the rest, at their ends."""
    most = F.least(F.length(x), F.length(y))
    return _let(_common(x, y, most, False), lambda n: F.struct(n.alias("begin"), _common(x, y, most - n, True).alias("end")))


def linked(a: Column, b: Column, most_edits: int) -> Column:
    """Whether two lines are within ``most_edits`` edits of characters, and those within a fifth of the longer one."""
    return F.when(F.length(b) == 0, F.lit(False)).otherwise(_distance_within(a, b, _edits(F.greatest(F.length(a), F.length(b)), most_edits), most_edits))


def _distance_within(a: Column, b: Column, edits: Column, most_edits: int) -> Column:
    """Whether the distance of two strings is at most ``edits``, which is at most ``most_edits``.

    What the strings have in common at both ends is taken off first. If two
    characters or more are left of each, one edit stands at either end, so at
    most ``edits - 2`` of four pieces between can be missing in the other string;
    most pairs end there. The rest goes to ``_within``.
    """

    def trimmed(s: Column) -> Column:
        return _let(_shared(s["a"], s["b"]), lambda x: F.struct(
            F.substring(s["a"], x["begin"] + 1, F.length(s["a"]) - x["begin"] - x["end"]).alias("a"), F.substring(s["b"], x["begin"] + 1, F.length(s["b"]) - x["begin"] - x["end"]).alias("b"), s["e"].alias("e"),
        ))

    def decided(s: Column) -> Column:
        na, nb = F.length(s["a"]), F.length(s["b"])
        cut = lambda q: 1 + F.floor((na - 2) * q / 4).cast("int")
        missing = sum((F.when(F.contains(s["b"], F.substring(s["a"], cut(q) + 1, cut(q + 1) - cut(q))), 0).otherwise(1) for q in range(4)), F.lit(0))
        short = F.least(na, nb)
        return (
            F.when(short == 0, F.greatest(na, nb) <= s["e"])
            .when((short >= 2) & (s["e"] < 2), F.lit(False))
            .when((short >= 2) & (missing > s["e"] - 2), F.lit(False))
            .otherwise(_within(s["a"], s["b"], s["e"], most_edits))
        )

    start = F.struct(a.alias("a"), b.alias("b"), edits.alias("e"))
    # strings of too different lengths don't come to the costly part
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(False)).otherwise(_let(start, lambda s: _let(trimmed(s), decided)))


def _within(pattern: Column, text: Column, edits: Column, most_edits: int) -> Column:
    """Whether the distance of two strings is at most ``edits`` (at most ``most_edits``), bit-parallel over a band of diagonals.

    Bit d + k of word e says that after the text's characters so far, the
    pattern's prefix d characters longer is within e edits; the words stand side
    by side in one long. A character moves every word at once: equal characters
    and replacements keep the diagonal, a character too many in the text moves
    down one, a character too many in the pattern moves up one.
    """
    k, width = most_edits, 2 * most_edits + 1
    band = (1 << width) - 1

    def equal(p: Column, t: Column) -> Column:
        """For each character of the text, the diagonals on which the pattern has the same."""
        at = lambda c, j: sum((F.when(F.get(p, j + d) == c, 1 << (d + k)).otherwise(0) for d in range(-k, k + 1)), F.lit(0))
        return F.transform(t, at)

    def move(state: Column, same: Column) -> Column:
        words = [F.shiftright(state, e * width).bitwiseAND(F.lit(band)) for e in range(k + 1)]
        new = [words[0].bitwiseAND(same)]
        for e in range(1, k + 1):
            any_of = words[e].bitwiseAND(same).bitwiseOR(words[e - 1]).bitwiseOR(F.shiftright(words[e - 1], 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(any_of.bitwiseAND(F.lit(band)))
        return sum((F.shiftleft(w, e * width) for e, w in enumerate(new)), F.lit(0).cast("long"))

    start = sum(sum(1 << (d + k) for d in range(e + 1)) << (e * width) for e in range(k + 1))
    end = F.length(pattern) - F.length(text) + k
    chars = F.struct(F.split(pattern, "").alias("p"), F.split(text, "").alias("t"))
    return _let(
        _let(chars, lambda c: F.aggregate(equal(c["p"], c["t"]), F.lit(start).cast("long"), move)),
        lambda state: F.call_function("getbit", state, (edits * width + end).cast("int")) == 1,
    )


#: The same rows by plain SQL: every two lines of nearly equal length that share a third are compared. DuckDB counts edits of bytes, so the
#: characters of more than one byte become ones of one byte that the texts don't have.
ORACLE_SQL = rf"""
with l as (select doc_id, pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null) where regexp_matches(line, '[^\x20\x09-\x0D]')),
wide as (select c, row_number() over (order by c) as k from (select distinct unnest(regexp_extract_all(line, '[^\x01-\x7F]')) as c from l)),
used as (select distinct unnest(regexp_extract_all(line, '[\x01-\x7F]')) as c from l),
free as (select chr(i::int) as c, row_number() over (order by i) as k from range(1, 128) r(i) where chr(i::int) not in (select c from used)),
maps as (select coalesce(string_agg(wide.c, '' order by k), '') as a, coalesce(string_agg(free.c, '' order by k), '') as b from wide join free using (k)),
d as (
  select line, first_doc, length(line) as n, translate(line, a, b) as m, row_number() over (order by first_doc, first_pos) as place
  from (select line, min(doc_id) as first_doc, min((doc_id, pos)) as p, arg_min(pos, (doc_id, pos)) as first_pos from l group by line), maps
),
s as (select line, place, n, m, unnest(range(n - {MOST_EDITS}, n + {MOST_EDITS + 1})) as n2, [substr(m, 1 + n * i // {MOST_EDITS + 1}, n * (i + 1) // {MOST_EDITS + 1} - n * i // {MOST_EDITS + 1}) for i in range({MOST_EDITS + 1})] as parts from d),
near as (
  select distinct b.line
  from s a join d b on a.n2 = b.n and a.place < b.place
  where ({" or ".join(f"contains(b.m, parts[{i + 1}])" for i in range(MOST_EDITS + 1))})
    and levenshtein(a.m, b.m) <= least({MOST_EDITS}, greatest(a.n, b.n) // {CHARS_PER_EDIT})
),
k as (
  select l.doc_id, l.pos, l.line,
    l.doc_id > d.first_doc or near.line is not null or row_number() over (partition by l.doc_id, l.line order by l.pos) > 1 as gone
  from l join d on d.line = l.line left join near on near.line = l.line
),
e as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
t as (select e.doc_id, coalesce(string_agg(e.line, chr(10) order by e.pos) filter (where not coalesce(k.gone, false)), '') as kept, count(k.line) as n, count(*) filter (where k.gone) as r from e left join k on k.doc_id = e.doc_id and k.pos = e.pos group by e.doc_id)
select documents.doc_id, coalesce(t.n, 0)::bigint as n_lines, coalesce(t.r, 0)::bigint as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256 from documents left join t on t.doc_id = documents.doc_id
"""
