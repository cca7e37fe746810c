"""Pitch, meter and chord expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semitone of each step; sharp names of the twelve classes.
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
# Offsets from the tonic that belong to a key or are commonly borrowed.
KEY_OFFSETS = [0, 2, 4, 5, 7, 9, 11, 3, 8, 10]
# Allowed quarter lengths.
LENGTHS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]
# Fixed pattern: chord symbols.
CHORD = (r"^[A-G][#b♯♭]?(?:min|maj|dim|aug|sus[24]?|m|M|°|\+)?"
         r"(?:6|7|9|11|13)?(?:add(?:2|4|6|9|11|13)|maj7|[#b](?:5|9|11|13))*"
         r"(?:/[A-G][#b♯♭]?)?$")
# Chord qualities and their kinds.
KINDS = {
    "": "major", "M": "major", "maj": "major", "m": "minor", "min": "minor", "7": "dominant", "maj7": "major-seventh", "M7": "major-seventh",
    "m7": "minor-seventh", "min7": "minor-seventh", "m7b5": "half-diminished", "dim": "diminished", "°": "diminished", "dim7": "diminished-seventh",
    "°7": "diminished-seventh", "aug": "augmented", "+": "augmented", "sus": "suspended-fourth", "sus4": "suspended-fourth", "sus2": "suspended-second",
    "6": "major-sixth", "m6": "minor-sixth", "9": "dominant-ninth", "maj9": "major-ninth", "M9": "major-ninth", "m9": "minor-ninth", "11": "dominant-11th", "13": "dominant-13th",
}


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """CASE over a small fixed mapping."""
    out = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(default) if default is not None else out


def pitch_class(step: Column, alter: Column) -> Column:
    return F.pmod(lookup(SEMITONES, step) + alter, F.lit(12))


def midi_pitch(step: Column, octave: Column, alter: Column) -> Column:
    """12 * (octave + 1) + semitone + alteration."""
    return 12 * (octave + 1) + lookup(SEMITONES, step) + alter


def expected_beats(beats: Column, beat_type: Column) -> Column:
    """Quarter lengths of a time signature; beats may be additive, as in 3+2."""
    total = F.aggregate(F.split(beats.cast("string"), r"\+"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return total * 4 / beat_type


def transposed(step: Column, octave: Column, alter: Column, by: int) -> Column:
    """struct<step, alter, octave> moved by semitones, spelt with sharps; B# and Cb carry the octave."""
    midi = midi_pitch(step, octave, alter) + by
    name = F.element_at(F.array(*[F.lit(x) for x in SHARPS]), (F.pmod(midi, F.lit(12)) + 1).cast("int"))
    return F.struct(F.substring(name, 1, 1).alias("step"), F.when(F.length(name) == 2, 1).otherwise(0).alias("alter"), (F.floor(midi / 12) - 1).alias("octave"))


def in_key(step: Column, alter: Column, fifths: Column) -> Column:
    """Whether a root belongs to the key of `fifths` or is commonly borrowed."""
    tonic = F.pmod(7 * fifths, F.lit(12))
    return F.pmod(pitch_class(step, alter) - tonic, F.lit(12)).isin(KEY_OFFSETS)


def key_alteration(step: Column, fifths: Column) -> Column:
    """Alteration of a step by the key signature."""
    sharp, flat = F.instr(F.lit("FCGDAEB"), step), F.instr(F.lit("BEADGCF"), step)
    return F.when((fifths > 0) & (sharp <= fifths), 1).when((fifths < 0) & (flat <= -fifths), -1).otherwise(0)


def is_chord(text: Column) -> Column:
    return F.trim(text).rlike(CHORD)


def chord_parts(text: Column) -> Column:
    """struct<step, alter, kind, bass_step, bass_alter>; kind is null for a quality that is not known, all null for no chord."""
    pattern = r"^([A-G])([#b]?)([^/]*)(?:/([A-G])([#b]?))?$"
    s = F.translate(F.trim(text), "♯♭", "#b")
    part = lambda i: F.regexp_extract(s, pattern, i)
    alter = lambda c: F.when(c == "#", 1).when(c == "b", -1).otherwise(0)
    return F.when(s.rlike(pattern), F.struct(part(1).alias("step"), alter(part(2)).alias("alter"), lookup(KINDS, part(3)).alias("kind"), F.nullif(part(4), F.lit("")).alias("bass_step"), alter(part(5)).alias("bass_alter")))


def chord_struct(text: Column) -> Column:
    """chord_parts() with `degrees` (value, alter, type); null for a quality that leaves something unread.

    A quality that is no known one is a known one with additions (add9) and
    alterations (#5, b9) behind it.
    """
    pattern = r"^[A-G][#b]?([^/]*)(?:/[A-G][#b]?)?$"
    quality = F.regexp_extract(F.translate(F.trim(text), "♯♭", "#b"), pattern, 1)
    split = r"^(.*?)((?:(?:add|[#b])\d+)*)$"
    whole = lookup(KINDS, quality)
    kind = F.coalesce(whole, lookup(KINDS, F.regexp_extract(quality, split, 1)))
    marks = F.regexp_extract_all(F.when(whole.isNull(), F.regexp_extract(quality, split, 2)).otherwise(""), F.lit(r"(?:add|[#b])\d+"), F.lit(0))
    sign = lambda d: F.left(d, F.lit(1))
    degree = lambda d: F.struct(F.regexp_extract(d, r"(\d+)$", 1).cast("int").alias("value"), F.when(sign(d) == "#", 1).when(sign(d) == "b", -1).otherwise(0).alias("alter"), F.when(sign(d) == "a", "add").otherwise("alter").alias("type"))
    c = chord_parts(text)
    return F.when(c.isNotNull() & kind.isNotNull(), F.struct(c["step"].alias("step"), c["alter"].alias("alter"), kind.alias("kind"), c["bass_step"].alias("bass_step"), c["bass_alter"].alias("bass_alter"), F.transform(marks, degree).alias("degrees")))


def chord_text(chord: Column) -> Column:
    """A chord struct of chord_parts() as text: root, sign, the first quality of its kind, bass."""
    sign = lambda a: F.when(a == 1, "♯").when(a == -1, "♭").otherwise("")
    shown: dict[str, str] = {}
    for quality, kind in KINDS.items():
        shown.setdefault(kind, quality)
    bass = F.when(chord["bass_step"].isNotNull(), F.concat(F.lit("/"), chord["bass_step"], sign(chord["bass_alter"]))).otherwise("")
    return F.concat(chord["step"], sign(chord["alter"]), lookup(shown | {"suspended-fourth": "sus4"}, chord["kind"], F.lit("")), bass)


# Major keys from seven flats to seven sharps.
KEYS = ["Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#"]


def key_name(fifths: Column, mode: str = "major") -> Column:
    """Name of a key signature, null beyond seven signs."""
    return F.concat(F.get(F.array(*[F.lit(k) for k in KEYS]), (fifths + (7 if mode == "major" else 10)).cast("int")), F.lit(f" {mode}"))


def transposed_symbol(text: Column, by: int) -> Column:
    """A chord symbol moved by semitones, bass included; other text stays."""
    pattern = r"^([A-G])([#b]?)([^/]*)(?:/([A-G])([#b]?))?$"

    def name(step: Column, accidental: Column) -> Column:
        pc = F.pmod(lookup(SEMITONES, step) + F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0) + by, F.lit(12))
        return F.element_at(F.array(*[F.lit(x) for x in SHARPS]), (pc + 1).cast("int"))

    part = lambda i: F.regexp_extract(text, pattern, i)
    bass = F.when(part(4) != "", F.concat(F.lit("/"), name(part(4), part(5)))).otherwise("")
    return F.when(text.rlike(pattern), F.concat(name(part(1), part(2)), part(3), bass)).otherwise(text)


def quantised(length: Column) -> Column:
    """The nearest allowed quarter length, the shorter one on a tie; 0.25 for what is not positive."""
    best = F.array_min(F.array(*[F.struct(F.abs(length - x).alias("off"), F.lit(x).alias("v")) for x in LENGTHS]))["v"]
    return F.when(length <= 0, F.lit(0.25)).otherwise(best)


def staff_position(y: Column, top: Column, interline: Column) -> Column:
    """Nearest line or space (0 is the top line, counted downwards in half spaces), up to eight ledger steps."""
    return F.array_min(F.transform(F.sequence(F.lit(-8), F.lit(16)), lambda k: F.struct(F.abs(top + k * interline / 2 - y).alias("off"), k.alias("k"))))["k"]


# Quarters of each note type, alteration of each accidental.
TYPES = {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25}
ACCIDENTALS = {"sharp": 1, "flat": -1, "natural": 0}


def edited_duration(kind: Column, dotted: Column, divisions: Column) -> Column:
    """Duration in divisions of a note type, at least 1."""
    return F.greatest(F.lit(1), F.round(divisions * lookup(TYPES, kind, F.lit(1.0)) * F.when(dotted, 1.5).otherwise(1.0))).cast("long")


def edited_alteration(accidental: Column, alter: Column) -> Column:
    return F.when(accidental.isNull(), alter).otherwise(lookup(ACCIDENTALS, accidental, alter))


def diatonic(bottom: Column, y: Column, interline: Column) -> Column:
    """Diatonic number of a head from its place (30 is E4, on the bottom line)."""
    return 30 + F.round((bottom - y) / (interline / 2)).cast("long")


def diatonic_name(number: Column) -> Column:
    return F.concat(F.substring(F.lit("CDEFGAB"), (number % 7).cast("int") + 1, F.lit(1)), F.floor(number / 7))
