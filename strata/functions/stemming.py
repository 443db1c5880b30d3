"""The English stemmer (Porter2) as SQL over a table of words.

Each step is one CASE on the word's ending, the longest first, so a table of words takes a scan without Python. Words
are lower-case letters and digits; p1 and p2 are the letters before the regions R1 and R2 of the published algorithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strata.operators.shared import shared_folder

# fixed values: the endings and exceptions of the published algorithm
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
PREFIXES = ["gener", "commun", "arsen"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]

_FIRST = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
#: A syllable that ends short: a vowel between consonants, the last not w, x or Y, or a vowel and a consonant alone.
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _cases(rules: list[tuple[str, str, str]], otherwise: str = "w") -> str:
    """CASE on the longest ending of `w`: (ending, what takes its place, when); an ending that fails its condition leaves the word."""
    out = "CASE"
    for ending, to, when in sorted(rules, key=lambda r: -len(r[0])):
        out += f" WHEN w LIKE '%{ending}' THEN CASE WHEN {when} THEN substr(w, 1, length(w) - {len(ending)}) || '{to}' ELSE w END"
    return f"{out} ELSE {otherwise} END"


def _in(region: str, ending: str) -> str:
    return f"length(w) - {len(ending)} >= {region}"


def stem_sql(words: str, group: str = "$1", like: str = "{0} RLIKE '{1}'") -> str:
    """SELECT of (word, stem) over a table of words (word); `group` names the first group of a replacement, `like` tests a pattern."""
    has = lambda pattern, of="w": like.format(of, pattern)
    region = lambda of, start: f"CASE WHEN {has(_FIRST, of)} THEN {start} + length(regexp_extract({of}, '{_FIRST}', 0)) ELSE length(w) END"
    one = "CASE " + " ".join(f"WHEN w LIKE '{p}%' THEN {len(p)}" for p in PREFIXES) + f" ELSE {region('w', 0)} END"
    kept = ", ".join(f"'{w}'" for w in AFTER_PLURAL)
    plural = "CASE WHEN w LIKE '%sses' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) "
    plural += f"WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN {has('[aeiouy].+s$')} THEN substr(w, 1, length(w) - 1) ELSE w END"
    past = {e: f"substr(w, 1, length(w) - {len(e)})" for e in ("ingly", "edly", "ing", "ed")}
    cut = f"CASE WHEN w LIKE '%eedly' OR w LIKE '%eed' THEN NULL {' '.join(f'''WHEN w LIKE '%{e}' THEN CASE WHEN {has('[aeiouy]', x)} THEN {x} END''' for e, x in past.items())} END"
    eed = _cases([("eedly", "ee", _in("p1", "eedly")), ("eed", "ee", _in("p1", "eed"))])
    doubled = " OR ".join(f"cut LIKE '%{d}'" for d in DOUBLES)
    again = f"CASE WHEN cut IS NULL THEN {eed} WHEN cut LIKE '%at' OR cut LIKE '%bl' OR cut LIKE '%iz' THEN cut || 'e' WHEN {doubled} THEN substr(cut, 1, length(cut) - 1) WHEN p1 >= length(cut) AND {has(_SHORT, 'cut')} THEN cut || 'e' ELSE cut END"
    last_y = f"CASE WHEN {has('.[^aeiouy][yY]$')} THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END"
    two = _cases([(e, to, _in("p1", e)) for e, to in STEP_2.items()] + [("ogi", "og", f"{_in('p1', 'ogi')} AND w LIKE '%logi'"), ("li", "", f"{_in('p1', 'li')} AND {has('[cdeghkmnrt]li$')}")])
    three = _cases([(e, to, _in("p1", e)) for e, to in STEP_3.items()] + [("ative", "", _in("p2", "ative"))])
    four = _cases([(e, "", _in("p2", e)) for e in STEP_4] + [("ion", "", f"{_in('p2', 'ion')} AND {has('[st]ion$')}")])
    ends = has(_SHORT, "substr(w, 1, length(w) - 1)")
    five = f"CASE WHEN w LIKE '%e' AND ({_in('p2', 'e')} OR ({_in('p1', 'e')} AND NOT {ends})) THEN substr(w, 1, length(w) - 1) WHEN w LIKE '%ll' AND {_in('p2', 'l')} THEN substr(w, 1, length(w) - 1) ELSE w END"
    out = f"SELECT word, regexp_replace(word, '(^|[aeiouy])y', '{group}Y'{GLOBAL[group]}) AS w FROM {words}"
    out = f"SELECT word, w, {one} AS p1 FROM ({out}) AS a"
    out = f"SELECT word, w, p1, {region('substr(w, p1 + 1)', 'p1')} AS p2 FROM ({out}) AS b"
    out = f"SELECT word, p1, p2, {plural} AS w FROM ({out}) AS c"
    out = f"SELECT word, w, p1, p2, {cut} AS cut FROM ({out}) AS d"
    done = f"w IN ({kept})"
    out = f"SELECT word, p1, p2, {done} AS done, CASE WHEN {done} THEN w ELSE {again} END AS w FROM ({out}) AS e"
    for i, step in enumerate((last_y, two, three, four, five)):
        out = f"SELECT word, p1, p2, done, CASE WHEN done THEN w ELSE {step} END AS w FROM ({out}) AS s{i}"
    whole = " ".join(f"WHEN word = '{w}' THEN '{s}'" for w, s in WHOLE.items())
    return f"SELECT word, CASE WHEN length(word) <= 2 THEN word {whole} ELSE replace(w, 'Y', 'y') END AS stem FROM ({out}) AS z"


#: How a dialect says that all places of a pattern are replaced.
GLOBAL = {"$1": "", "\\1": ", 'g'"}


def duckdb_sql(words: str) -> str:
    return stem_sql(words, "\\1", "regexp_matches({0}, '{1}')")


def stems(words: DataFrame) -> DataFrame:
    """(word, stem) of a table of words (word); a null word has a null stem.

    Checkpointed: a filter on the stem, pushed through the steps, would repeat each of them in the next.
    """
    shared_folder(words.sparkSession)
    return words.sparkSession.sql(stem_sql("{words}"), words=words.select("word")).checkpoint()
