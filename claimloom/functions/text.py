"""Text functions that are safe for Indic scripts."""

from pyspark.sql import functions as F

# Letters, combining marks, digits, zero-width non-joiner and joiner. Java `\w`
# matches no Devanagari or Gujarati letter, and without the joiners a conjunct
# that holds one would fall apart into two tokens.
TOKEN = r"[\p{L}\p{M}\p{Nd}\x{200C}\x{200D}]+"
# Latin sentence ends, danda and double danda, line breaks.
SENTENCE_END = r"[.!?।॥\n]+"
SPACE = r"[ \t\n\r\f\x{00A0}]+"
WORD = r"[^ \t\n\r\f\x{00A0}]+"

# Order decides ties.
SCRIPTS = (("Devanagari", "IsDevanagari"), ("Gujarati", "IsGujarati"), ("Latin", "IsLatin"))


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def once(col, use):
    """`use(value)` with the value computed once per row.

    A costly expression that is named in several branches of a CASE is evaluated
    again in each; a lambda variable is not.
    """
    return F.get(F.transform(F.array(_col(col)), use), 0)


def non_blank(col):
    """Null instead of the empty string."""
    return F.get(F.filter(F.array(_col(col)), lambda v: v != ""), 0)


def clean_text(col):
    """Collapse white space and trim; blank becomes null."""
    return non_blank(F.trim(F.regexp_replace(_col(col), SPACE, " ")))


def tokenize(col):
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(TOKEN), F.lit(0))


def sentence_tokens(col):
    """Array of sentences, each an array of tokens with their case kept."""
    sentences = F.split(_col(col), SENTENCE_END)
    tokens = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)))
    return F.filter(tokens, lambda t: F.size(t) > 0)


def _pairs(block):
    """The letters of a script's block of code points, and as many ASCII characters that its texts seldom hold, no blank, line break, digit or stop."""
    letters = [chr(block + i) for i in range(0x01, 0x70) if i not in (0x64, 0x65)]
    rare = [chr(i) for i in range(1, 128) if chr(i) not in " \n.,0123456789"][:len(letters)]
    return "".join(letters + rare), "".join(rare + letters)


# By the mark that a packed text begins with: the script, and which characters are swapped with which.
PACKED = {"d": ("IsDevanagari", *_pairs(0x0900)), "g": ("IsGujarati", *_pairs(0x0A80))}


def pack(col):
    """Text for the way through a shuffle: one byte a letter instead of three in the scripts of `PACKED`; `unpack` gives it back as it was.

    The letters of the script swap places with ASCII characters, a mark in front tells the script. Texts of two bytes a character or
    fewer, and those that are no valid UTF-8, only get a mark. Blanks and line breaks stay what they are.
    """
    text = _col(col)
    found = F.regexp_extract(text, "[" + "".join(rf"\p{{{name}}}" for name, _, _ in PACKED.values()) + "]", 0)
    wide = (F.octet_length(text) > 2 * F.char_length(text)) & F.is_valid_utf8(text)
    packed = F.concat(F.lit("-"), text)
    for mark, (name, letters, swapped) in PACKED.items():
        packed = F.when(wide & found.rlike(rf"\p{{{name}}}"), F.concat(F.lit(mark), F.translate(text, letters, swapped))).otherwise(packed)
    return packed


def unpack(col):
    """The text that `pack` was given."""
    text = _col(col)
    whole = F.substr(text, F.lit(2))
    unpacked = whole
    for mark, (_, letters, swapped) in PACKED.items():
        unpacked = F.when(F.startswith(text, F.lit(mark)), F.translate(whole, letters, swapped)).otherwise(unpacked)
    return unpacked


def char_len(col):
    """Length in code points."""
    return F.char_length(_col(col)).cast("int")


def word_len(col):
    """Words between white space; blank text has none."""
    return F.regexp_count(_col(col), F.lit(WORD)).cast("int")


def detect_script(col):
    """Script with the most letters; ties go to the first of SCRIPTS, none to Other.

    Hindi and Marathi share Devanagari, so a language can not be read off this.
    """
    text = _col(col)
    # A run of other letters is dropped as one match. One maximum over all scripts
    # counts each script once per row.
    ranked = [
        F.struct(
            F.char_length(F.regexp_replace(text, r"[^\p{" + cls + r"}]+", "")).alias("n"),
            F.lit(-i).alias("order"),
            F.lit(name).alias("name"),
        )
        for i, (name, cls) in enumerate(SCRIPTS)
    ]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit("Other").alias("name"))
    return F.when(text.isNotNull(), F.array_max(F.array(*ranked, none))["name"])
