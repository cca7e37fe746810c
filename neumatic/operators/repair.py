"""Proposals that would make a measure come out right. Nothing is changed unless a caller asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rational as q

# Note lengths in quarters as fractions, and how far a length, a total or a trimmed note may go.
ALLOWED = ((1, 4), (1, 2), (3, 4), (1, 1), (3, 2), (2, 1), (3, 1), (4, 1), (6, 1), (8, 1))
GHOST, SNAP, SLACK, LEAST = (1, 1000), (1, 20), (1, 100), (1, 8)


def _given(pair: tuple[int, int]) -> Column:
    return F.struct(F.lit(pair[0]).cast("long").alias("num"), F.lit(pair[1]).cast("long").alias("den"))


def _nearest(length: Column) -> Column:
    """(off, quarter): the allowed length nearest to a fraction (the shorter of two) in sixteenths of a whole note, and its distance in 1/(4 den)."""
    options = F.array(*(F.lit(4 * n // d).cast("long") for n, d in ALLOWED))
    best = F.array_min(F.transform(options, lambda o: F.struct(F.abs(4 * length["num"] - o * length["den"]).alias("off"), o.alias("quarter"))))
    shortest = F.lit(4 * ALLOWED[0][0] // ALLOWED[0][1]).cast("long")
    return F.when(length["num"] <= 0, F.struct(F.abs(4 * length["num"] - shortest * length["den"]).alias("off"), shortest.alias("quarter"))).otherwise(best)


def quantised(length: Column) -> Column:
    """The allowed length nearest to a fraction, the shorter of two; the shortest for 0 or less."""
    return q.fraction(_nearest(length)["quarter"], 4)


def expected_quarters(beats: Column, beat_type: Column) -> Column:
    """Length of a measure in quarters from its (additive) beats and beat type; null without them."""
    parts = F.transform(F.split(beats.cast("string"), r"\+"), lambda b: F.trim(b).cast("long"))
    return q.fraction(F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b) * 4, beat_type)


def proposals(events: DataFrame, measures: DataFrame, *, key: str = "measure_key") -> DataFrame:
    """key, seq, action, length, fits: what would be done to each note or rest of a measure.

    events: key, seq, kind, is_chord, length (fraction of quarters); measures:
    key, expected (fraction). In turn: lengths of at most 0.001 are dropped;
    others go to the nearest allowed length if it is more than 0.05 away; the
    last is trimmed by what the measure has too much (to 1/8 at least, then to
    an allowed length); a rest is appended for what it lacks. Chord notes take
    the length of the note that they belong to. fits says whether the lengths
    then add up to what is expected. Measures with backup or forward have
    several voices, so their sum says nothing: they get no proposal, nor do
    those without an expected length.
    """
    whole = events.groupBy(key).agg(F.bool_or(F.col("kind").isin("backup", "forward")).alias("voices"), F.array_sort(F.collect_list(F.when(F.col("kind") == "note", F.struct("seq", "is_chord", "length")))).alias("held"))
    m = whole.where("not voices").join(measures.where("expected is not null").select(key, "expected"), key)
    lead = F.transform("held", lambda x, i: F.struct(x["seq"].alias("seq"), x["length"].alias("was"), (x["is_chord"] & (i > 0)).alias("chord"), (q.compare(x["length"], _given(GHOST)) <= 0).alias("ghost")))
    m = m.withColumn("held", lead)
    far = lambda x: _nearest(x["was"])["off"] * SNAP[1] > 4 * SNAP[0] * x["was"]["den"]
    near = lambda x: F.when(far(x), quantised(x["was"])).otherwise(x["was"])
    m = m.withColumn("held", F.transform("held", lambda x: F.struct(x["seq"].alias("seq"), x["was"].alias("was"), x["chord"].alias("chord"), x["ghost"].alias("ghost"), near(x).alias("length"))))
    main = F.filter("held", lambda x: ~x["ghost"] & ~x["chord"])
    m = m.withColumn("main", main).withColumn("last", F.array_max(F.transform("main", lambda x: x["seq"])))
    m = m.withColumn("over", q.minus(q.total(F.transform("main", lambda x: x["length"])), F.col("expected")))
    shorter = lambda x: q.minus(x["length"], F.col("over"))
    cut = lambda x: quantised(F.when(q.compare(shorter(x), _given(LEAST)) < 0, _given(LEAST)).otherwise(shorter(x)))
    trims = (q.compare(F.col("over"), _given(SLACK)) > 0)
    m = m.withColumn("main", F.transform("main", lambda x: F.struct(x["seq"].alias("seq"), F.when(trims & (x["seq"] == F.col("last")), cut(x)).otherwise(x["length"]).alias("length"))))
    m = m.withColumn("total", q.total(F.transform("main", lambda x: x["length"])))
    lack = q.minus(F.col("expected"), F.col("total"))
    appends = (F.col("total")["num"] > 0) & (q.compare(lack, _given(SLACK)) > 0)
    m = m.withColumn("rest", F.when(appends, quantised(lack)))
    m = m.withColumn("fits", q.compare(F.col("expected"), F.when(appends, q.add(F.col("total"), F.col("rest"))).otherwise(F.col("total"))) == 0)
    # a chord note has the length of the last main note before it
    owner = lambda x: F.array_max(F.transform(F.filter("main", lambda y: y["seq"] <= x["seq"]), lambda y: y["seq"]))
    new = lambda x: F.get(F.transform(F.filter("main", lambda y: y["seq"] == owner(x)), lambda y: y["length"]), F.lit(0))
    rows = F.transform("held", lambda x: F.struct(x["seq"].alias("seq"), x["was"].alias("was"), x["ghost"].alias("ghost"), F.coalesce(new(x), x["length"]).alias("length"), (trims & (owner(x) == F.col("last"))).alias("trimmed")))
    added = F.when(appends, F.array(F.struct((F.array_max(F.transform("held", lambda x: x["seq"])) + 1).alias("seq"), F.lit(None).cast("struct<num:bigint,den:bigint>").alias("was"), F.lit(False).alias("ghost"), F.col("rest").alias("length"), F.lit(False).alias("trimmed"))))
    e = m.select(key, "fits", F.explode(F.concat(rows, F.coalesce(added, F.array().cast("array<struct<seq:bigint,was:struct<num:bigint,den:bigint>,ghost:boolean,length:struct<num:bigint,den:bigint>,trimmed:boolean>>")))).alias("e")).select(key, "fits", "e.*")
    action = F.when(F.col("was").isNull(), "append").when(F.col("ghost"), "drop").when(q.compare(F.col("was"), F.col("length")) == 0, "keep").when(F.col("trimmed"), "trim").otherwise("quantise")
    return e.select(key, "seq", action.alias("action"), F.when(~F.col("ghost"), F.col("length")).alias("length"), "fits")


def applied(events: DataFrame, proposed: DataFrame, *, key: str = "measure_key", opt_in: bool = False) -> DataFrame:
    """events with the proposals carried out: `length` changed, ghosts gone, rests appended. Without opt_in they stay as they are."""
    if not opt_in:
        return events
    p = proposed.select(key, "seq", "action", F.col("length").alias("_length"))
    changed = events.join(p.where("action <> 'append'"), [key, "seq"], "left").where("action is null or action <> 'drop'")
    changed = changed.withColumn("length", F.coalesce("_length", "length")).drop("action", "_length")
    rests = p.where("action = 'append'").select(key, "seq", F.lit("note").alias("kind"), F.lit(False).alias("is_chord"), F.lit(True).alias("is_rest"), F.col("_length").alias("length"))
    return changed.unionByName(rests, allowMissingColumns=True)


def diatonic_at(bottom: Column, y: Column, interline: Column) -> Column:
    """Diatonic step (30 on the lowest line) of a height."""
    return 30 + F.round((bottom - y) / (interline / 2)).cast("long")


def altered(step: Column, fifths: Column) -> Column:
    """Alteration that a key gives to a step."""
    order = F.when(fifths > 0, "FCGDAEB").otherwise("BEADGCF")
    return F.when(F.instr(F.left(order, F.abs(fifths).cast("int")), step) > 0, F.when(fifths > 0, 1).otherwise(-1)).otherwise(0)


def tuplet_gates(candidates: DataFrame, heads: DataFrame, evidence: DataFrame, *, key: str = "measure_key") -> DataFrame:
    """key, gates and adjusted tick lengths of each candidate measure against the heads of the image.

    candidates: key, seq, step, octave, alter_by, is_chord, is_pitched, ticks;
    heads: key, x, y, hollow, tie (order of equal x); evidence: key, divisions,
    expected (fraction of quarters), fifths, bottom, interline, spans (array of
    struct<x1,x2>, one for each bracket with a 3). Notes and heads are matched
    by position. `agrees` needs: as many heads as notes, all pitched, no chords;
    one bracket over exactly three filled quarters; pitches and hollowness as
    in the image; just two quarters left for the three, in whole ticks.
    """
    notes = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "step", "octave", "alter_by", "ticks"))).alias("notes"), F.every(F.col("is_pitched") & ~F.col("is_chord")).alias("plain"))
    seen = heads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "tie", "y", "hollow"))).alias("heads"))
    m = evidence.join(notes, key).join(seen, key, "left").withColumn("heads", F.coalesce("heads", F.array().cast(seen.schema["heads"].dataType)))
    m = m.withColumn("span", F.when(F.size("spans") == 1, F.get("spans", F.lit(0))))
    m = m.withColumns({"as_many": F.col("plain") & (F.size("notes") == F.size("heads"))})
    pairs = F.zip_with("notes", "heads", lambda n, h: F.struct(n["seq"].alias("seq"), n["step"].alias("step"), n["octave"].alias("octave"), n["alter_by"].alias("alter_by"), n["ticks"].alias("ticks"), h["hollow"].alias("hollow"), diatonic_at(F.col("bottom"), h["y"], F.col("interline")).alias("at"), F.coalesce(h["x"].between(F.col("span")["x1"] - F.col("interline"), F.col("span")["x2"] + F.col("interline")), F.lit(False)).alias("inside")))
    m = m.withColumn("pairs", F.when(F.col("as_many"), pairs).otherwise(F.array().cast("array<struct<seq:bigint,step:string,octave:bigint,alter_by:int,ticks:bigint,hollow:boolean,at:bigint,inside:boolean>>")))
    inside = F.filter("pairs", lambda p: p["inside"])
    m = m.withColumn("filled", (F.size(inside) == 3) & F.forall(inside, lambda p: ~p["hollow"] & (p["ticks"] == F.col("divisions"))))
    step = lambda p: F.substring(F.lit("CDEFGAB"), F.pmod(p["at"], F.lit(7)).cast("int") + 1, F.lit(1))
    same = F.forall("pairs", lambda p: (p["step"] == step(p)) & (p["octave"] == F.floor(p["at"] / 7)) & (p["alter_by"] == altered(step(p), F.col("fifths"))) & (p["hollow"] == (p["ticks"] >= 2 * F.col("divisions"))))
    outside = F.filter("pairs", lambda p: ~p["inside"])
    left = q.minus(F.coalesce("expected", q.fraction(0)), q.fraction(F.aggregate(outside, F.lit(0).cast("long"), lambda a, p: a + p["ticks"]), F.col("divisions")))
    m = m.withColumns({"pitches": F.col("as_many") & same, "remaining": left})
    third = q.times(F.col("remaining"), q.fraction(F.col("divisions"), 3))
    m = m.withColumn("exact", (third["den"] == 1) & (F.col("remaining")["num"] == 2) & (F.col("remaining")["den"] == 1))
    m = m.withColumn("agrees", F.coalesce(F.col("as_many") & F.col("filled") & F.col("pitches") & F.col("exact"), F.lit(False)))
    new = F.transform("pairs", lambda p: F.struct(p["seq"].alias("seq"), F.when(p["inside"], third["num"]).otherwise(p["ticks"]).alias("ticks")))
    return m.select(key, "as_many", F.col("span").isNotNull().alias("one_bracket"), "filled", "pitches", "remaining", "exact", "agrees", F.when(F.col("agrees"), new).alias("adjusted"))


def image_proposals(heads: DataFrame, evidence: DataFrame, *, key: str = "measure_key") -> DataFrame:
    """key, tie, at (diatonic step), quarters (fraction): notes that heads alone would give.

    The first bracket must cover exactly three filled heads, all others must be
    hollow (a half note each), and one or two quarters must be left for the
    three. Accidentals and stems are not read, so it stays a proposal.
    """
    m = heads.join(evidence.where(F.size("spans") > 0).select(key, "expected", "bottom", "interline", F.get("spans", F.lit(0)).alias("span")), key)
    m = m.withColumn("inside", F.col("x").between(F.col("span")["x1"] - F.col("interline"), F.col("span")["x2"] + F.col("interline")))
    counts = m.groupBy(key).agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"), F.bool_or(F.col("inside") & F.col("hollow")).alias("white_in"), F.every(F.col("inside") | F.col("hollow")).alias("white_out"), F.first("expected").alias("expected"))
    left = q.minus(F.coalesce("expected", q.fraction(0)), q.fraction(2 * F.col("n_out")))
    counts = counts.withColumn("left", left).where("n_in = 3 and n_out > 0 and not white_in and white_out and left.den = 1 and left.num in (1, 2)").select(key, "left")
    return m.join(counts, key).select(key, "tie", diatonic_at(F.col("bottom"), F.col("y"), F.col("interline")).alias("at"), F.when(F.col("inside"), q.fraction(F.col("left")["num"], 3)).otherwise(q.fraction(2)).alias("quarters"))


def verified(candidates: DataFrame, heads: DataFrame, verses: DataFrame, current: DataFrame, *, key: str = "measure_key") -> DataFrame:
    """key and the gates of each candidate measure, with `verified` if it passes all.

    candidates: key, seq, is_chord, ticks, divisions, xml_sha256 (what it was
    made for); heads: key, n; verses: key, verse, n; current: key, divisions,
    expected (fraction), xml_sha256. As many heads as notes; at least one verse
    and all with as many words as notes; the length that the meter asks for;
    every duration in whole ticks of the current measure; made for the measure
    as it is now.
    """
    c = candidates.groupBy(key).agg(F.count("*").alias("notes"), q.fraction(F.sum(F.when(~F.col("is_chord"), F.col("ticks")).otherwise(0)), F.first("divisions")).alias("length"), F.collect_set("ticks").alias("ticks"), F.first("divisions").alias("own"), F.first("xml_sha256").alias("made_for"))
    v = verses.groupBy(key).agg(F.collect_set("n").alias("counts"))
    m = current.join(c, key).join(heads.select(key, F.col("n").alias("heads")), key, "left").join(v, key, "left")
    gates = {
        "heads_match": F.coalesce(F.col("heads") == F.col("notes"), F.lit(False)),
        "verses_match": F.coalesce((F.size("counts") == 1) & F.array_contains("counts", F.col("notes")), F.lit(False)),
        "beats_match": F.coalesce(q.compare(F.col("length"), F.col("expected")) == 0, F.lit(False)),
        "exact": F.forall("ticks", lambda t: q.fraction(t * F.col("divisions"), F.col("own"))["den"] == 1),
        "current": F.coalesce(F.col("made_for") == F.col("xml_sha256"), F.lit(False)),
    }
    m = m.withColumns(gates)
    every = F.lit(True)
    for name in gates:
        every &= F.col(name)
    return m.select(key, *gates, every.alias("verified"))
