"""Column functions on section labels. All are expressions: nothing runs outside the JVM.

ASCII letters, digits and white space are meant; other characters pass through.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE = "silence"
#: Labels that count as silence, most wanted first.
SILENCE_LIKE = ("silence", "nothing", "silent", "no music")

#: Words for ordinals.
ORDINAL_WORDS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
    "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)

#: Names behind the run-together labels of the harmonix preset.
ALIASES = {
    "altchorus": "alternate chorus",
    "bigoutro": "big outro",
    "build": "build up",
    "chorushalf": "chorus half",
    "chorusinst": "instrumental chorus",
    "drumroll": "drum roll",
    "fadein": "fade in",
    "fadeout": "fade out",
    "fastchorus": "fast chorus",
    "gtr": "guitar",
    "gtrbreak": "guitar break",
    "guitarsolo": "guitar solo",
    "inst": "instrumental",
    "instbridge": "instrumental bridge",
    "instchorus": "instrumental chorus",
    "instintro": "instrumental intro",
    "instrumentalverse": "instrumental verse",
    "intchorus": "interlude chorus",
    "introverse": "intro verse",
    "mainriff": "main riff",
    "oddriff": "odd riff",
    "opening": "opening",
    "postchorus": "post chorus",
    "postverse": "post verse",
    "ppostchorus": "post post chorus",
    "prechorus": "pre chorus",
    "preverse": "pre verse",
    "quietchorus": "quiet chorus",
    "raps": "rap",
    "rhythmlessintro": "rhythmless intro",
    "section": "generic section",
    "slow": "slow section",
    "slowverse": "slow verse",
    "stutter": "stutter section",
    "synth": "synthesizer",
    "transtiion": "transition",
    "verseslow": "slow verse",
    "verseinst": "instrumental verse",
    "vocalintro": "vocal intro",
    "vocaloutro": "vocal outro",
}

#: What a section of each name is, in the words of the music_structure preset.
DESCRIPTIONS = {
    "alternate chorus": "a chorus variant with a changed arrangement or musical role.",
    "big outro": "an expanded closing section at the end of the song.",
    "break": "a short contrasting or reduced-texture section within the song.",
    "breakdown": "a reduced or contrasting section where the groove, texture, or energy changes.",
    "bridge": "a contrasting transitional section between other sections.",
    "build up": "a section that increases energy or tension before a later section.",
    "chorus": "the main repeated hook or refrain section of the song.",
    "chorus half": "a shortened chorus section containing only part of the main refrain.",
    "drum roll": "a short drum-led transition or build-up passage.",
    "fade in": "an opening section where the song gradually increases from silence.",
    "fade out": "a closing section where the song gradually decreases toward silence.",
    "guitar": "a section featuring guitar material.",
    "guitar break": "a short contrasting section led by guitar material.",
    "guitar solo": "a featured instrumental passage led by guitar.",
    "instrumental": "a section without lead vocals or with instrumental focus.",
    "instrumental bridge": "an instrumental contrasting transitional section between other sections.",
    "instrumental chorus": "an instrumental version of the chorus or refrain section.",
    "instrumental intro": "an instrumental opening section before the main body of the song.",
    "instrumental verse": "an instrumental version of a verse-like section.",
    "interlude": "a short connecting passage between larger song sections.",
    "interlude chorus": "a chorus-like interlude or short refrain passage between larger sections.",
    "intro": "the opening section before the main body of the song.",
    "intro verse": "an opening section with verse-like material.",
    "main riff": "a section centered on the song's primary repeated instrumental riff.",
    "opening": "an opening passage before the main body of the song.",
    "outro": "the closing section at the end of the song.",
    "post chorus": "a section following the chorus, often extending or resolving the hook.",
    "post post chorus": "a section following a post-chorus, often extending the chorus area further.",
    "pre chorus": "a build-up section before the chorus.",
    "pre verse": "a short section leading into a verse.",
    "quiet chorus": "a softer or reduced version of the chorus section.",
    "rap": "a rap vocal section, often functioning like a verse or featured passage.",
    "rhythmless intro": "an opening section before the main rhythmic groove begins.",
    "generic section": "a numbered or otherwise unspecified structural section.",
    "silence": "a silent or near-silent region.",
    "slow section": "a slower or reduced-energy section.",
    "slow verse": "a slower or reduced-energy verse-like section.",
    "solo": "a featured instrumental passage, often highlighting one instrument.",
    "stutter section": "a section using repeated or chopped rhythmic material.",
    "synthesizer": "a section featuring synthesizer material.",
    "transition": "a connecting section that moves between other song sections.",
    "verse": "a recurring lyrical section, usually distinct from the chorus.",
    "vocal intro": "an opening section featuring vocals before the main body of the song.",
    "vocal outro": "a closing section featuring vocals at the end of the song.",
}

#: The prompt of each mode, with its named fields.
TEMPLATES = {
    "bare": "{label}",
    "compact": "Music structure label: {label}",
    "descriptive": "Music structure label: {label}. Base type: {base_label}. Occurrence: {occurrence_description}. Meaning: {description}. Use this label for frames belonging to this section.",
    "occurrence_descriptive": "Music structure label: {label}. Meaning: {occurrence_prompt}. Use this label for frames belonging to {occurrence_prompt}.",
}

#: Families, in the order in which they are tried, and what a base label of each contains.
FAMILIES = (
    ("prechorus", ("pre chorus", "prechorus")),
    ("postchorus", ("post chorus", "postchorus")),
    ("chorus", ("chorus",)),
    ("verse", ("verse",)),
    ("bridge", ("bridge",)),
    ("intro", ("intro",)),
    ("outro", ("outro", "fade out", "fadeout")),
    ("instrumental", ("inst", "instrument", "solo", "gtr")),
    ("break_transition", ("break", "interlude", "transition")),
    ("silence", ("silence",)),
)
FAMILY_SILENT = ("none", "no function")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def squeeze(col: Column | str) -> Column:
    """Stripped, with every run of white space as one space."""
    return strip(F.regexp_replace(_c(col), r"\s+", " "))


def _spaced(col: Column | str, both: bool) -> Column:
    """Lower case, runs of _ and - as a space, a space between a letter and a digit after it (and, if both, before it)."""
    out = F.regexp_replace(F.lower(strip(col)), r"[_\-]+", " ")
    out = F.regexp_replace(out, r"(?<=[a-z])(?=\d)", " ")
    return F.regexp_replace(out, r"(?<=\d)(?=[a-z])", " ") if both else out


def label_base(col: Column | str) -> Column:
    """L1: the label without its occurrence number."""
    return F.regexp_replace(squeeze(_spaced(col, True)), r"\s+[0-9]+(?:\s*[a-z])?$", "")


def canonical_underscore(col: Column | str) -> Column:
    """L2: as policies compare labels."""
    return F.regexp_replace(F.lower(strip(col)), r"[\s_\-]+", "_")


def canonical_space(col: Column | str) -> Column:
    """L3: as filters and annotator scores compare labels."""
    return squeeze(F.regexp_replace(F.lower(strip(col)), r"[_\-]", " "))


def canonical_key(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(col)), r"[\s_\-]+", "")


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key) if pairs else F.lit(None).cast("string")


def generic_label(col: Column | str, overrides: Mapping[str, str] | None = None) -> Column:
    """L6."""
    return F.coalesce(_lookup(overrides or {}, canonical_key(col)), _spaced(col, False))


def harmonix_label(col: Column | str, overrides: Mapping[str, str] | None = None) -> Column:
    """An override or alias of the whole key, else of its stem with the number kept, else generic."""
    key = canonical_key(col)
    number = F.regexp_extract(key, r"^([a-z]+)([0-9]+[a-z]?)$", 2)
    stem = F.when(number == "", key).otherwise(F.regexp_extract(key, r"^([a-z]+)([0-9]+[a-z]?)$", 1))
    tail = F.when(number == "", "").otherwise(F.concat(F.lit(" "), number))
    own = overrides or {}
    return F.coalesce(_lookup(own, key), F.concat(_lookup(own, stem), tail), _lookup(ALIASES, key), F.concat(_lookup(ALIASES, stem), tail), generic_label(col, own))


def normalize_label(col: Column | str, preset: str = "none", overrides: Mapping[str, str] | None = None, whitespace: bool = True) -> Column:
    """L4: presets none, harmonix and generic."""
    presets = {"none": lambda: _c(col), "harmonix": lambda: harmonix_label(col, overrides), "generic": lambda: generic_label(col, overrides)}
    if preset.lower() not in presets:
        raise ValueError(f"unknown label preset {preset!r}; there are {', '.join(presets)}")
    out = presets[preset.lower()]()
    return squeeze(out) if whitespace else out


def readable_label(col: Column | str) -> Column:
    return squeeze(_spaced(col, False))


def prompt_label(raw: Column | str, text: Column | str, same_text: Column) -> Column:
    """``same_text`` counts the labels of the set with this text; if several, the raw label tells them apart."""
    return F.when(same_text > 1, F.concat(_c(text), F.lit(" ("), readable_label(raw), F.lit(")"))).otherwise(_c(text))


def occurrence_base(col: Column | str) -> Column:
    """The label without a parenthesis at its end and without its number."""
    text = _no_parenthesis(col)
    return F.when(text.rlike(r"^.+?\s+[0-9]+$"), F.regexp_extract(text, r"^(.+?)\s+([0-9]+)$", 1)).otherwise(text)


def occurrence_index(col: Column | str) -> Column:
    """The number, or null."""
    text = _no_parenthesis(col)
    return F.when(text.rlike(r"^.+?\s+[0-9]+$"), F.regexp_extract(text, r"^(.+?)\s+([0-9]+)$", 2).cast("long"))


def _no_parenthesis(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(col)), r"\s*\([^)]*\)\s*$", "")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 10th to 20th of each hundred."""
    last = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), last)


def ordinal_word(n: Column) -> Column:
    """First to twentieth, numbers beyond."""
    words = F.array(*[F.lit(w) for w in ORDINAL_WORDS])
    return F.when(n.between(1, len(ORDINAL_WORDS)), F.get(words, (n - 1).cast("int"))).otherwise(ordinal(n))


def occurrence_description(base: Column, index: Column) -> Column:
    """L10: 'a verse section', or 'the 2nd verse section in chronological order'."""
    article = F.when(F.lower(F.substring(base, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")
    return F.when(index.isNull(), F.concat(article, F.lit(" "), base, F.lit(" section"))).otherwise(F.concat(F.lit("the "), ordinal(index), F.lit(" "), base, F.lit(" section in chronological order")))


def occurrence_prompt(base: Column, index: Column) -> Column:
    """L10."""
    return F.when(index.isNull(), F.concat(F.lit("the "), base, F.lit(" section"))).otherwise(F.concat(F.lit("the "), ordinal_word(index), F.lit(" occurrence of the "), base, F.lit(" section in this song")))


def description(base: Column, preset: str = "none", overrides: Mapping[str, str] | None = None) -> Column:
    """L11."""
    known = (DESCRIPTIONS if preset == "music_structure" else {}) | dict(overrides or {})
    return F.regexp_replace(F.coalesce(_lookup(known, base), F.concat(F.lit("a music structure section annotated as "), base)), r"\.+$", "")


def prompt(raw: Column | str, text: Column | str, label: Column | str, mode: str = "bare", template: str | None = None, preset: str | None = None, descriptions: Mapping[str, str] | None = None, whitespace: bool = True) -> Column:
    """The template, cut once at its fields, as one concatenation."""
    import string

    if mode.lower() not in TEMPLATES:
        raise ValueError(f"unknown prompt mode {mode!r}; there are {', '.join(sorted(TEMPLATES))}")
    base, index = occurrence_base(text), occurrence_index(text)
    number = F.coalesce(index.cast("string"), F.lit(""))
    fields = {
        "label": _c(label), "raw_label": _c(raw), "text_label": _c(text), "base_label": base, "occurrence": number, "occurrence_index": number,
        "occurrence_description": occurrence_description(base, index), "occurrence_prompt": occurrence_prompt(base, index),
        "description": description(base, preset or ("music_structure" if mode.lower() == "descriptive" else "none"), descriptions),
    }
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template or TEMPLATES[mode.lower()]):
        parts += [F.lit(literal)] * bool(literal) + ([fields[name]] if name is not None else [])
    out = F.concat(*parts)
    return squeeze(out) if whitespace else out


def label_family(col: Column | str) -> Column:
    """L13."""
    base = label_base(col)
    out = F.when(F.lit(False), "")
    for name, marks in FAMILIES:
        test = reduce(lambda a, b: a | b, [base.contains(m) for m in marks])
        out = out.when(test | base.isin(*FAMILY_SILENT) if name == "silence" else test, name)
    return out.otherwise("other")


def silence_label_in(labels: Column | str) -> Column:
    """The silence-like label of an array, the most wanted kind; of several cases the last; else null."""
    found = [F.try_element_at(F.filter(_c(labels), _is(name)), F.lit(-1)) for name in SILENCE_LIKE]
    return F.coalesce(*found)


def _is(name: str):
    return lambda x: F.lower(x) == name


def ensure_silence_label(labels: Column | str) -> Column:
    """L15."""
    return F.when(F.exists(_c(labels), lambda x: canonical_underscore(x) == SILENCE), _c(labels)).otherwise(F.array_append(_c(labels), SILENCE))


def slug(col: Column | str) -> Column:
    """L16."""
    return F.regexp_replace(_c(col), r"[^A-Za-z0-9_\-]", "_")


def policy_slug(policy: str, **options: object) -> str:
    """The name of a policy with the options that are set."""
    import re

    parts = [policy, *(f"{k}_{v}" for k, v in sorted(options.items()) if v not in (None, (), ""))]
    return "_".join(re.sub(r"[^A-Za-z0-9_\-]", "_", str(p)) for p in parts)


def hash_embedding(col: Column | str, dim: int = 16) -> Column:
    """The SHA-256 bytes of a string, repeated to ``dim`` numbers between -1 and 1, of length 1."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    numbers = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    # as elements of arrays the digest and the numbers are made once, not once for each use
    return F.transform(F.transform(F.array(F.sha2(_c(col), 256)), numbers), unit)[0]


def unit(vector: Column) -> Column:
    """The vector by its length, a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(F.struct(vector.alias("v"), norm.alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def draw_key(*parts: F.Column) -> F.Column:
    """60 bits of the MD5 of the parts as text, with colons between: a draw that any SQL can follow."""
    text = F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
