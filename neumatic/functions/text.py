"""Text expressions for lyrics: folding, tones, syllables, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vietnamese vowels by tone (level, grave, acute, hook, tilde, dot).
TONES = ["aàáảãạ", "ăằắẳẵặ", "âầấẩẫậ", "eèéẻẽẹ", "êềếểễệ", "iìíỉĩị", "oòóỏõọ", "ôồốổỗộ", "ơờớởỡợ", "uùúủũụ", "ưừứửữự", "yỳýỷỹỵ"]
BASES = "aaaeeiooouuy"
MARKED = "".join(TONES) + "đ"
FOLDED = "".join(b * 6 for b in BASES) + "d"
TONELESS = "".join(row[0] * 6 for row in TONES) + "đ"
TONE_OF = "".join("012345" for _ in TONES)


def fold(text: Column) -> Column:
    """Lower case without Vietnamese marks, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, FOLDED), r"[^\p{L}\p{N}]", "")


def strip_tone(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, TONELESS)


def tone(text: Column) -> Column:
    """Largest tone number (0 level) of the text's vowels."""
    vowels = F.regexp_replace(F.lower(text), f"[^{MARKED[:-1]}]", "")
    digits = F.translate(vowels, MARKED[:-1], TONE_OF)
    return F.coalesce(F.array_max(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))), F.lit(0))


def mark_count(text: Column) -> Column:
    """Letters that carry a mark (or are đ)."""
    low = F.lower(text)
    plain = "".join(c for c, f in zip(MARKED, FOLDED) if c == f)
    marked = "".join(c for c, f in zip(MARKED, FOLDED) if c != f)
    assert plain
    return F.length(low) - F.length(F.translate(low, marked, ""))


def syllabic(text: Column) -> Column:
    """struct<text, syllabic>: hyphens at either end tell the place of a syllable in its word."""
    lead, trail = text.startswith("-"), text.endswith("-")
    clean = F.trim(F.regexp_replace(text, r"^-+|-+$", ""))
    return F.struct(clean.alias("text"), F.when(lead & trail, "middle").when(trail, "begin").when(lead, "end").otherwise("single").alias("syllabic"))


def match_case(text: Column, like: Column) -> Column:
    """`text` in capitals or with a capital first letter, as `like` is."""
    letters = F.regexp_replace(like, r"[^\p{L}]", "")
    all_caps = (F.length(letters) > 1) & (letters == F.upper(letters))
    first = F.substring(letters, 1, 1)
    return F.when(all_caps, F.upper(text)).when((first != "") & (first == F.upper(first)), F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))).otherwise(text)


def uppercase_ratio(text: Column) -> Column:
    """Share of capital letters among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def comparison_tokens(text: Column) -> Column:
    """Lower-case words of letters only."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L} ]", ""), " "), lambda w: w != "")


def natural_key(name: Column) -> Column:
    """Sort key by which page-2 comes before page-10: digit runs without leading zeros, after the number of their digits."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.concat(F.lpad(F.length(F.ltrim(r, F.lit("0"))).cast("string"), 6, "0"), F.ltrim(r, F.lit("0")))).otherwise(r)), "")


# Fixed patterns: a reference at the end of a line, and how every line that has one ends (found without trying each beginning).
SCRIPTURE = r"""((?:[1-3I]{1,3}\s+)?[^—–,:]{2,24}\s+\d{1,3}:\d{1,3})\s*[”"']?\s*$"""
SCRIPTURE_END = r"""\d:\d{1,3}\s*[”"']?\s*$"""


def _scripture_place(text: Column) -> Column:
    """The end of the line that holds its reference: it has one colon, no dash and no comma."""
    end = F.substring_index(text, ":", -2)
    for mark in "—–,":
        end = F.substring_index(end, mark, -1)
    return end


def has_scripture(text: Column) -> Column:
    """Whether the line ends in a reference; most lines are done with their last letters."""
    return text.rlike(SCRIPTURE_END) & _scripture_place(text).rlike(SCRIPTURE)


def scripture(text: Column) -> Column:
    """The reference at the end of a line, empty without one."""
    return F.when(text.rlike(SCRIPTURE_END), F.regexp_extract(_scripture_place(text), SCRIPTURE, 1)).otherwise("")


# Fixed patterns: verse numbers (2. or Lời 3:) and section markers with the section they begin.
VERSE = r"(?i)^(?:(?:lời|lòi|verse|phiên khúc|câu)\s*)?(\d{1,2})\s*[.:)]$"
SECTIONS = {"chorus": r"(?iu)^(?:đk\d*|điệp\s*khúc|chorus|refrain)\s*[.:)]*$", "coda": r"(?iu)^(?:coda|kết|fine|d\.?\s*[cs]\.?)\s*[.:)]*$", "intro": r"(?iu)^(?:intro|dạo(?:\s*đầu)?)\s*[.:)]*$"}


def verse_number(text: Column) -> Column:
    """Number of a verse marker, 1 to 99; null for other text."""
    found = F.regexp_extract(F.trim(text), VERSE, 1)
    return F.when(found != "", F.nullif(found.cast("int"), F.lit(0)))


def section_marker(text: Column) -> Column:
    """Section that a marker begins; null for other text."""
    out = F
    for name, pattern in SECTIONS.items():
        out = out.when(F.trim(text).rlike(pattern), name)
    return out


# Fixed patterns: marks that are no lyrics. Shares of chords and of known words that decide a line.
MARKS = {"tempo": r"(?i)(?:andante|allegro|moderato|largo|lento|tempo|♩\s*=\s*\d+)", "key_info": r"(?i)(?:capo|tone|key)\s*:?\s*\w+", "direction": r"(?i)^(?:d\.?\s*[cs]\.?|fine|coda)\s*[.:)]*$", "footer": r"^\s*\d{1,4}\s*$"}
CHORD_LINE, WORD_LINE = 0.7, 0.3


def line_role(body: Column, chord_ratio: Column, word_ratio: Column, band: Column) -> Column:
    """Role of a text line from its band, its shares of chords and known words, and marks; unknown where nothing speaks."""
    marks = F
    for name, pattern in MARKS.items():
        marks = marks.when(body.rlike(pattern), name)
    out = marks.when((chord_ratio >= CHORD_LINE) & (word_ratio < WORD_LINE), "chord").when(word_ratio >= WORD_LINE, "lyric")
    return out.when(band == "header", "header").otherwise("unknown")


def role_sql(body: str) -> str:
    """line_role() of a line below a staff as a CASE of SQL."""
    marks = " ".join(f"WHEN regexp_matches({body}, '{p}') THEN '{name}'" for name, p in MARKS.items())
    return f"CASE {marks} WHEN chord_ratio >= {CHORD_LINE} AND word_ratio < {WORD_LINE} THEN 'chord' WHEN word_ratio >= {WORD_LINE} THEN 'lyric' ELSE 'unknown' END"


def status(raw: Column) -> Column:
    """READY, NEEDS_REVIEW or FAILED; everything else is PROCESSING."""
    return F.when(F.upper(raw).isin("READY", "NEEDS_REVIEW", "FAILED"), F.upper(raw)).otherwise("PROCESSING")
