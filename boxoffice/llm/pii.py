"""Surrogates for personal data (operator 3), in SQL functions only.

Every entity of a text (e-mail address, phone, card, IP address, social security number, IBAN, secret, name
after a title) gets a replacement drawn from a keyed hash of its normal form: of the same kind, script,
letter case and punctuation, names of the same gender, card numbers with a right check digit. The same
entity gets the same replacement everywhere, also where it is written otherwise.

Different entities must get different replacements, and none may be the normal form of another entity of
the tables. So all distinct entities and their replacements are counted against each other; where two meet,
all but one draw again, from some draw on in longer and longer forms, until none do. Only entities that drew again travel to the texts: a table that is
empty or nearly so, joined by a hash of the text, which Spark broadcasts only if its files are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.staging import drop, packed, staged
from boxoffice.llm.staging import quoted as quoted_name

KEPT_DRAWS = 4  # draws in the form of the original; each one after them has a sign more, so that all settle

# Titles by gender; a name stands after one of them
FEMALE = "Mrs Ms Miss Frau Señora Señorita Sra Madame Mme Mlle Signora Г-жа Госпожа Κυρία".split()
MALE = "Mr Herr Señor Sr Monsieur Signor Г-н Господин Κύριος".split()
EITHER = "Dr Prof".split()

# Names to draw from, in the lower case
GIVEN = {
    ("f", "latin"): "anna maria clara julia laura sofia emma lena nora ines paula rosa alice elena irene marta vera lucia helen ruth",
    ("m", "latin"): "paul peter david martin thomas daniel simon oscar victor hugo leo felix marco anton emil karl ivan luis jan otto",
    ("x", "latin"): "alex kim robin sascha andrea dominique noa charlie sam jo",
    ("f", "cyrillic"): "анна мария елена ольга ирина наталья вера софия",
    ("m", "cyrillic"): "иван пётр павел антон сергей виктор олег борис",
    ("x", "cyrillic"): "саша женя валя",
    ("f", "greek"): "άννα μαρία ελένη σοφία ειρήνη",
    ("m", "greek"): "γιώργος νίκος πέτρος παύλος",
    ("x", "greek"): "άλεξ ρένα",
}
FAMILY = {
    "latin": "walker keller moreno dubois fischer romero laurent bennett vogel garrido mercier hughes brandt navarro fontaine palmer lorenz vidal renard sutton",
    "cyrillic": "орлов соколов лебедев морозов волков зайцев павлов козлов",
    "greek": "παπάς γεωργίου νικολάου δημητρίου",
}
SYLLABLES = {
    "latin": "ba der lin mor sen tal ver wyn kos rum fel nad pir gon hul jes cam zor tev lau",
    "cyrillic": "ба дер лин мор сен тал вер кос рум фел",
    "greek": "βα δερ λιν μορ σεν ταλ κοσ ρουμ",
}
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHan}": "安北城大东方国海河江金京南平青山水天文西新云中",
    r"\p{IsLatin}": "àáâäçèéêëìíîïñòóôöùúûü",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}

WORD_BEFORE, WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
ONE_TITLE = rf"(?:{'|'.join(FEMALE + MALE + EITHER)})"
DEGREE = r"(?:med|dent|vet|phil|rer|nat|pol|oec|jur|theol|habil|mult|h|c|hc)\."
GAP = r"[ \t\xa0]{1,2}"
# several may be stacked; a line may end after one
TITLE = rf"{WORD_BEFORE}(?:{ONE_TITLE}(?:\.?-Ing)?(?:\.\s?|[\s\xa0]{{1,2}})(?:{DEGREE} ?)*+){{1,5}}"
# a word of a name: O'Brien, d'Arc, al-Rashid, McDonald, Anna-Maria, but of Smith's only Smith; an initial with its dot
SHORTENED = r"(?:s|ll|d|ve|re|m|t)(?!\p{L})"
WORD = rf"(?:\p{{Ll}}{{1,5}}['’-])?\p{{Lu}}(?:\.|[\p{{L}}\p{{M}}]*+(?:(?:-|['’](?!{SHORTENED}))\p{{L}}[\p{{L}}\p{{M}}]*+)*+)"
INITIAL = r"^\p{Lu}\.?$"
PARTICLE = rf"(?:von|vom|van|vander|und|zu|zur|zum|de|del|della|dello|degli|dei|der|den|di|da|das|do|dos|du|des|la|las|le|les|lo|los|ter|ten|te|af|av|bin|bint|ibn|ben|al|el|abu|san|st\.|y|e|i|'t){GAP}"
# further words: no title of the next person, no Jr, no bare letter unless a name goes on
FURTHER = rf"(?!{ONE_TITLE}(?:\. ?|{GAP})\p{{Lu}}|(?:Jr|Sr|II|III|IV|PhD|MD)(?!\p{{L}})|\p{{Lu}}(?![\p{{L}}\p{{M}}.'’-]|{GAP}\p{{Lu}}|$))"
NAME = rf"(?:{PARTICLE}){{0,4}}(?!{ONE_TITLE}(?:\. ?|{GAP})\p{{Lu}}){WORD}(?:(?:{GAP}(?:{PARTICLE}){{0,4}}|(?<=\.)-?){FURTHER}{WORD})*+"
KEYWORD = rf"{WORD_BEFORE}(?i:token|secret|password|api[_-]?key)[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
# a secret after a keyword: anything in quotes, else a long word or a shorter one with a digit
QUOTED = "|".join(rf"(?<={q})(?=[^{q}\r\n]*[\p{{L}}0-9])[^{q}\r\n]{{4,200}}+(?={q}|$)" for q in "\"'")
SIGN = r"(?:[A-Za-z0-9+/_=!@#$%^*~-]|&(?![A-Za-z_]+=)|\.(?=[A-Za-z0-9]))"
BARE = rf"(?=[^\s\d]{{0,64}}\d){SIGN}{{4,}}+|[A-Za-z0-9+/_-]{{16,}}+"
# four signs of an IBAN; letters alone only before a group with a digit
GROUP = r"(?:(?=[A-Z]{0,3}\d)[A-Z0-9]{4}|[A-Z]{4}(?= [A-Z]{0,3}\d))"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# Kinds in the order in which they are tried
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": rf"{KEYWORD}(?:{QUOTED}|{BARE})|{WORD_BEFORE}(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}+){WORD_AFTER}",
    "iban": rf"{WORD_BEFORE}[A-Z]{{2}}\d\d(?:[A-Z0-9]{{11,30}}|(?<=(?:MU|SC)\d\d)(?: {GROUP}){{5,6}} [A-Z]{{2,3}}|(?: {GROUP}){{3,7}}(?: (?=[A-Z]{{0,2}}\d)[A-Z0-9]{{1,3}})?|(?: {GROUP}){{2}} (?=[A-Z]{{0,2}}\d)[A-Z0-9]{{3}}){WORD_AFTER}",
    "card": r"(?<![\p{L}\p{N}.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": rf"(?<![\p{{L}}\p{{N}}-])\d{{3}}-\d\d-\d{{4}}(?![\p{{L}}\p{{N}}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![\p{L}\p{N}])",
    "person": rf"{TITLE}{NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Every text with a match holds one of these, and they are much quicker to look for: parts of words, some in
# any case, or four digits with at most two signs between any two, or the begin of an IBAN
MARKS = sorted({"@", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", *FEMALE, *MALE, *EITHER})
ANY_CASE_MARKS = ["token", "secret", "password", "apikey", "api_key", "api-key"]
DIGIT_MARK = r"\d(?:[ .()-]{0,2}\d){3}|[A-Z]{2}\d\d"


def may_match(text: Column) -> Column:
    tests = [F.contains(text, F.lit(m)) for m in MARKS if not any(o != m and o in m for o in MARKS)]
    tests += [F.contains(F.lower(text), F.lit(m)) for m in ANY_CASE_MARKS] + [text.rlike(DIGIT_MARK)]
    return reduce(lambda a, b: a | b, tests)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def draw(seed: str, at: str, n: int) -> str:
    """A number below ``n``, by SQL."""
    return f"CAST(pmod(xxhash64({seed}, {at}), {n}) AS INT)"


def picked(names: str, seed: str, at: str) -> str:
    words = names.split()
    return f"get(array({', '.join(map(quoted, words))}), {draw(seed, at, len(words))})"


def scrambled(text: str, seed: str) -> str:
    """Letters become letters of the same script and case, digits digits; the rest stays."""
    cases = "".join(f" WHEN substr({text}, i, 1) RLIKE {quoted(c)} THEN substr({quoted(a)}, 1 + {draw(seed, 'i', len(a))}, 1)" for c, a in {"[0-9]": "0123456789", **LETTERS}.items())
    return f"array_join(transform(sequence(1, length({text})), i -> CASE{cases} ELSE substr({text}, i, 1) END), '')"


def hexed(text: str, seed: str) -> str:
    return f"array_join(transform(sequence(1, length({text})), i -> lower(hex({draw(seed, 'i', 16)}))), '')"


def more(alphabet: str, seed: str, attempt: str) -> str:
    """A sign for each attempt after the first ones."""
    sign = f"substr({quoted(alphabet)}, 1 + {draw(seed, 'j + 1000000', len(alphabet))}, 1)"
    return f"CASE WHEN {attempt} < {KEPT_DRAWS} THEN '' ELSE array_join(transform(sequence(1, {attempt} - {KEPT_DRAWS - 1}), j -> {sign}), '') END"


def luhn(digits: str) -> str:
    """The check sum of a card number, 0 if it is right."""
    digit = f"CAST(substr({digits}, length({digits}) + 1 - i, 1) AS INT)"
    doubled = f"({digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> (a + CASE WHEN i % 2 = 0 THEN {doubled} ELSE {digit} END) % 10)"


def script(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {quoted(r'\p{IsCyrillic}')} THEN 'cyrillic' WHEN {text} RLIKE {quoted(r'\p{IsGreek}')} THEN 'greek' ELSE 'latin' END"


def drawn(kind: str, norm: str, seed: str, attempt: str, key: str) -> str:
    """SQL for the replacement of a normal form."""
    local, domain, tld = (f"regexp_extract({norm}, {quoted(p)}, 1)" for p in ("^(.*)@", r"@(.*)\.[^.]*$", r"(\.[^.]*)$"))
    digits, letters_too = more("0123456789", seed, attempt), more("abcdefghijklmnopqrstuvwxyz", seed, attempt)
    body = f"concat(substr({norm}, 1, 1), {scrambled(f'substr({norm}, 2, length({norm}) - 2)', seed)}, {digits})"
    private = f"{norm} RLIKE {quoted(r'^(10|127)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.')}"
    octets = [f"{draw(seed, str(k), 254)} + 1" for k in (1, 2, 3)]
    ipv6 = ", ".join(f"substr({seed}, {k}, 4)" for k in range(1, 29, 4))
    names = {("family", s): n for s, n in FAMILY.items()} | {(f"given_{g}", s): n for (g, s), n in GIVEN.items()}
    cases = {
        f"{kind} = 'email'": f"concat({scrambled(local, seed)}, {letters_too}, '@', {scrambled(domain, f'sha2(concat({key}, {domain}), 256)')}, {tld})",
        f"{kind} = 'card'": f"transform(array({body}), b -> concat(b, (10 - {luhn("concat(b, '0')")}) % 10))[0]",
        # a private network that has too few addresses gives way to 10.0.0.0/8, that to all, these to IPv6
        f"{kind} = 'ip' AND {attempt} >= {4 * KEPT_DRAWS}": f"concat_ws(':', 'fd00', {ipv6})",
        f"{kind} = 'ip' AND {private} AND {attempt} < {KEPT_DRAWS}": f"concat(regexp_extract({norm}, {quoted(r'^(\d+\.\d+\.)')}, 1), {octets[0]}, '.', {octets[1]})",
        f"{kind} = 'ip' AND {private} AND {attempt} < {2 * KEPT_DRAWS}": f"concat_ws('.', '10', {', '.join(octets)})",
        f"{kind} = 'ip'": f"concat_ws('.', {draw(seed, '0', 100)} + 11, {', '.join(octets)})",
        # the country code stays; no area or exchange code begins with 0 or 1
        f"{kind} = 'phone' AND {norm} LIKE '+%'": f"concat(substr({norm}, 1, 3), {scrambled(f'substr({norm}, 4)', seed)}, {digits})",
        f"{kind} = 'phone'": f"concat({draw(seed, '-1', 8)} + 2, {scrambled(f'substr({norm}, 2, 2)', seed)}, {draw(seed, '-2', 8)} + 2, {scrambled(f'substr({norm}, 5)', f'reverse({seed})')}, {digits})",
        f"{kind} = 'iban'": f"concat(substr({norm}, 1, 2), {scrambled(f'substr({norm}, 3)', seed)}, {digits})",
        f"{kind} = 'secret' AND {norm} RLIKE '^(AKIA|gh[pousr]_|sk-)'": f"concat(regexp_extract({norm}, '^(AKIA|gh[pousr]_|sk-)', 1), {scrambled(f'substr({norm}, length(regexp_extract({norm}, {quoted("^(AKIA|gh[pousr]_|sk-)")}, 1)) + 1)', seed)}, {digits})",
        f"{kind} = 'secret' AND {norm} RLIKE '^([0-9a-f]+|[0-9A-F]+)$'": f"concat(CASE WHEN {norm} RLIKE '[A-F]' THEN upper({hexed(norm, seed)}) ELSE {hexed(norm, seed)} END, {digits})",
        f"{kind} IN ('secret', 'ssn')": f"concat({scrambled(norm, seed)}, {digits})",
    }
    # each letter another one by the same shift: as few as they are, initials are not counted against each other
    for letters, alphabet in (("cyrillic", LETTERS[r"\p{IsCyrillic}"]), ("greek", LETTERS[r"\p{IsGreek}"]), ("latin", LETTERS["[a-z]"])):
        shift = f"1 + {draw(f'sha2({key}, 256)', '0', len(alphabet) - 1)}"
        cases[f"{kind} = 'initial' AND {script(norm)} = '{letters}'"] = f"substr({quoted(alphabet)}, 1 + (greatest(instr({quoted(alphabet)}, {norm}) - 1, 0) + {shift}) % {len(alphabet)}, 1)"
    for (what, letters), pool in names.items():
        syllables = f"array_join(transform(sequence(1, {attempt}), j -> {picked(SYLLABLES[letters], seed, 'j')}), '')"
        ending = f"CASE WHEN {norm} LIKE '%а' THEN 'а' ELSE '' END" if (what, letters) == ("family", "cyrillic") else "''"
        cases[f"{kind} = '{what}' AND {script(norm)} = '{letters}'"] = f"concat({picked(pool, seed, '0')}, CASE WHEN {attempt} > 0 THEN {syllables} ELSE '' END, {ending})"
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases.items()) + f" ELSE {norm} END"


def laid(said: str, new: str, chars: str, length: str | None = None) -> str:
    """``said`` with its characters of the class ``chars`` replaced, the last ``length`` (all) ones by those of
    ``new``, of which any more follow."""
    only = lambda text: f"regexp_replace({text}, {quoted(f'[^{chars}]')}, '')"
    length = length or f"length({only(said)})"
    nth = f"(length({only(f'substr({said}, 1, i)')}) - length({only(said)}) + {length})"
    changed = f"array_join(transform(sequence(1, length({said})), i -> CASE WHEN substr({said}, i, 1) RLIKE '[{chars}]' AND {nth} > 0 THEN substr({new}, {nth}, 1) ELSE substr({said}, i, 1) END), '')"
    return f"concat({changed}, substr({new}, {length} + 1))"


def cased(like: str, new: str) -> str:
    return f"CASE WHEN length({like}) > 1 AND {like} = upper({like}) THEN upper({new}) ELSE initcap({new}) END"


def kind_of(m: str) -> str:
    """SQL for the kind of a match; null for a number that only looks like a card."""
    tests = " ".join(f"WHEN {m} RLIKE {quoted(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items() if k != "card")
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    is_card = f"{m} RLIKE {quoted(f'^(?:{PATTERNS["card"]})$')}"
    return f"CASE WHEN {is_card} THEN CASE WHEN {luhn(digits)} = 0 THEN 'card' END {tests} END"


def name_of(m: str) -> str:
    return f"regexp_extract({m}, {quoted(f'^{TITLE}({NAME})$')}, 1)"


def name_words(name: str) -> str:
    return f"regexp_extract_all({name}, {quoted(WORD)}, 0)"


def units_of(kind: str, m: str) -> str:
    """SQL for the entities in a match, as (kind, norm): one, or the words of a name, the last of which is the family name.

    Given names have the gender of the title, as have the words that stand alone after one, of which `identified` says
    what they are.
    """
    one = lambda k, norm: f"array(named_struct('kind', {k}, 'norm', {norm}))"
    titled = lambda titles: f"{m} RLIKE {quoted(f'^(?:{"|".join(titles)})[. ]')}"
    gendered = lambda kind: f"CASE WHEN {titled(FEMALE)} THEN '{kind}_f' WHEN {titled(MALE)} THEN '{kind}_m' ELSE '{kind}_x' END"
    words = name_words(name_of(m))
    is_initial = f"w RLIKE {quoted(INITIAL)}"
    last = f"array_max(transform({words}, (w, p) -> CASE WHEN {is_initial} THEN -1 ELSE p END))"
    alone = f"size(filter({words}, w -> NOT w RLIKE {quoted(INITIAL)})) = 1"
    what = f"CASE WHEN {is_initial} THEN 'initial' WHEN p < last THEN {gendered('given')} WHEN {alone} THEN {gendered('lone')} ELSE 'family' END"
    norm = f"CASE WHEN {is_initial} THEN lower(substr(w, 1, 1)) ELSE replace(lower(w), '’', '\\'') END"
    named = f"flatten(transform(array({last}), last -> transform({words}, (w, p) -> named_struct('kind', {what}, 'norm', {norm}))))"
    dialled = f"regexp_replace({m}, '[^0-9+]', '')"
    return f"""CASE
      WHEN {kind} = 'person' THEN {named}
      WHEN {kind} = 'email' THEN {one(kind, f"lower({m})")}
      WHEN {kind} = 'secret' THEN {one(kind, f"regexp_replace({m}, {quoted(f'^{KEYWORD}')}, '')")}
      WHEN {kind} = 'iban' THEN {one(kind, f"replace({m}, ' ', '')")}
      WHEN {kind} IN ('card', 'ssn') THEN {one(kind, f"regexp_replace({m}, '[^0-9]', '')")}
      WHEN {kind} = 'phone' THEN {one(kind, f"CASE WHEN {dialled} RLIKE '^[+]1[0-9]{{10}}$' THEN substr({dialled}, 3) ELSE {dialled} END")}
      WHEN {kind} = 'ip' THEN {one(kind, m)}
      ELSE CAST(array() AS ARRAY<STRUCT<kind: STRING, norm: STRING>>) END"""


def written(kind: str, m: str, subs: str) -> str:
    """SQL for a match with its entities replaced by ``subs``, in the form of the match."""
    sub = f"{subs}[0]"
    name = name_of(m)
    word = f"CASE WHEN w RLIKE {quoted(INITIAL)} THEN concat(upper({subs}[p]), substr(w, 2)) ELSE {cased('w', f'{subs}[p]')} END"
    dialled = f"regexp_replace({m}, '[^0-9+]', '')"
    # what stands between the words of a name stays
    renamed = f"array_join(zip_with(split({name}, {quoted(WORD)}, -1), transform({name_words(name)}, (w, p) -> {word}), (a, b) -> concat(a, coalesce(b, ''))), '')"
    capitals = f"array_join(transform(sequence(1, length({sub})), i -> CASE WHEN {m} = upper({m}) OR substr({m}, i, 1) RLIKE {quoted(r'\p{Lu}')} THEN upper(substr({sub}, i, 1)) ELSE substr({sub}, i, 1) END), '')"
    return f"""CASE
      WHEN {kind} IS NULL THEN {m}
      WHEN {kind} = 'person' THEN concat(substr({m}, 1, length({m}) - length({name})), {renamed})
      WHEN {kind} = 'email' THEN {capitals}
      WHEN {kind} = 'secret' THEN concat(regexp_extract({m}, {quoted(f"^({KEYWORD})?")}, 0), {sub})
      WHEN {kind} = 'iban' THEN {laid(m, sub, "A-Z0-9")}
      WHEN {kind} = 'ip' THEN {sub}
      WHEN {kind} = 'phone' AND {dialled} RLIKE '^[+]1[0-9]{{10}}$' THEN {laid(m, f"regexp_replace({sub}, '[^0-9]', '')", "0-9", "10")}
      ELSE {laid(m, f"regexp_replace({sub}, '[^0-9]', '')", "0-9")} END"""


def with_mentions(docs: DataFrame) -> DataFrame:
    """``found``: the matches of each text in order, as (said, kind, units)."""
    found = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("said")))
    none = F.array().cast("array<struct<said: string>>")
    df = docs.withColumn("found", F.when(may_match(F.col("text")), found).when(F.col("text").isNotNull(), none))
    df = df.withColumn("found", F.expr(f"transform(found, f -> named_struct('said', f.said, 'kind', {kind_of('f.said')}))"))
    return df.withColumn("found", F.expr(f"transform(found, f -> named_struct('said', f.said, 'kind', f.kind, 'units', {units_of('f.kind', 'f.said')}))"))


def seed(key: str, kind: str, norm: str, attempt: str) -> str:
    return f"sha2(concat_ws('|', {key}, {kind}, {attempt}, {norm}), 256)"


def with_draw(entities: DataFrame, key: str) -> DataFrame:
    """``sub`` from kind, norm and attempt."""
    key = quoted(key)
    df = entities.withColumn("seed", F.expr(seed(key, "kind", "norm", "attempt")))
    return df.withColumn("sub", F.expr(drawn("kind", "norm", "seed", "attempt", key))).drop("seed")


def identified(mentions: DataFrame) -> DataFrame:
    """``(kind, norm, identity)`` of distinct ``(kind, norm)``: what an entity is, over all its mentions.

    A given name after a title without gender has the gender that its other mentions agree on. A word alone after a title
    is a family name, unless it is only known as a given name.
    """
    saw = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    facts = mentions.filter("kind RLIKE '^(given|lone)_|^family$'").groupBy("norm").agg(
        saw("given_f", "lone_f").alias("f"), saw("given_m", "lone_m").alias("m"), saw("family").alias("family"), saw("given_f", "given_m", "given_x").alias("given")
    )
    agreed = "CASE WHEN f AND NOT m THEN 'given_f' WHEN m AND NOT f THEN 'given_m' ELSE 'given_x' END"
    identity = f"""CASE WHEN kind LIKE 'lone%' AND (family OR NOT given) THEN 'family' WHEN kind IN ('given_x', 'lone_x') THEN {agreed}
        WHEN kind LIKE 'lone%' THEN concat('given', substr(kind, 5)) ELSE kind END"""
    return mentions.join(facts, "norm", "left").select("kind", "norm", F.expr(identity).alias("identity"))


def settled(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, norm, space, attempt, sub)`` for distinct ``(kind, norm)``: no two of a space share a ``sub``, none is
    a ``norm`` of it. All names are one space, every other kind is its own."""
    space = F.expr("CASE WHEN kind LIKE 'given%' OR kind = 'family' THEN 'name' ELSE kind END")
    now = staged(with_draw(entities.withColumn("space", space).withColumn("attempt", F.lit(0)), key), "entities")
    while True:
        holders = now.groupBy("space", "sub").agg(F.min(F.struct("attempt", "norm", "kind")).alias("holder"), F.count("*").alias("n"))
        taken = now.select("space", F.col("norm").alias("sub"), F.lit(True).alias("taken")).distinct()
        clashes = holders.join(taken, ["space", "sub"], "left").filter("n > 1 OR taken")
        clashes = clashes.select("space", "sub", F.when(F.col("taken").isNull(), F.struct("holder.norm", "holder.kind")).alias("holder"))
        again = now.join(clashes, ["space", "sub"]).filter("NOT holder <=> named_struct('norm', norm, 'kind', kind)")
        again = staged(again.select("kind", "norm", "space", "attempt"), "entities-again")
        if again.isEmpty():
            return now
        moved = with_draw(again.withColumn("attempt", F.col("attempt") + 1), key)
        after = staged(now.join(again, ["kind", "norm"], "left_anti").unionByName(moved.select(now.columns)), "entities")
        drop(now)
        now = after


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``(row, text, n_entities)``; ``row`` holds the columns other than text."""
    base = docs.select(packed([c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    found = with_mentions(base).withColumn("text_hash", F.xxhash64("text"))
    unit = F.explode(F.flatten("found.units")).alias("u")
    said = staged(found.filter("size(found) > 0").select("text_hash", unit).select("text_hash", "u.kind", "u.norm").distinct(), "mentions")
    who = staged(identified(said.filter("kind <> 'initial'").select("kind", "norm").distinct()), "identities")
    final = settled(who.select(F.col("identity").alias("kind"), "norm").distinct(), key)
    # mentions that are not what they look like, or whose first draw was not free
    final = who.join(final.select(F.col("kind").alias("identity"), "norm", "attempt"), ["identity", "norm"])
    odd = final.filter("attempt > 0 OR identity <> CASE WHEN kind LIKE 'lone%' THEN 'family' ELSE kind END")
    redrawn = said.join(odd, ["kind", "norm"])
    entry = F.struct(F.concat_ws("|", "kind", "norm"), F.struct("identity", "attempt"))
    redrawn = redrawn.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(entry)).alias("again"))
    df = found.join(staged(redrawn, "redrawn"), "text_hash", "left")
    quoted_key = quoted(key)
    known = "try_element_at(again, concat_ws('|', u.kind, u.norm))"
    kind = f"coalesce({known}.identity, CASE WHEN u.kind LIKE 'lone%' THEN 'family' ELSE u.kind END)"
    steps = {
        "attempt": f"named_struct('kind', {kind}, 'norm', u.norm, 'attempt', coalesce({known}.attempt, 0))",
        "seed": f"named_struct('kind', u.kind, 'norm', u.norm, 'attempt', u.attempt, 'seed', {seed(quoted_key, 'u.kind', 'u.norm', 'u.attempt')})",
        "sub": drawn("u.kind", "u.norm", "u.seed", "u.attempt", quoted_key),
    }
    for step in steps.values():
        df = df.withColumn("found", F.expr(f"transform(found, f -> named_struct('said', f.said, 'kind', f.kind, 'units', transform(f.units, u -> {step})))"))
    df = df.withColumn("written", F.expr(f"transform(found, f -> {written('f.kind', 'f.said', 'f.units')})"))
    # full names, the longest first, also where they recur without a title
    name = name_of("z.found.said")
    full = f"named_struct('size', -length({name}), 'name', {name}, 'new', substr(z.written, length(z.found.said) - length({name}) + 1))"
    persons = "filter(arrays_zip(found, written), z -> z.found.kind = 'person')"
    names = f"array_sort(array_distinct(filter(transform({persons}, z -> {full}), n -> n.name RLIKE {quoted(GAP)})))"
    df = df.withColumn("names", F.expr(f"CASE WHEN exists(found, f -> f.kind = 'person') THEN {names} END"))
    alike = f"concat({quoted(WORD_BEFORE + chr(92) + 'Q')}, n.name, {quoted(chr(92) + 'E' + WORD_AFTER)})"
    swapped = f"aggregate(names, named_struct('text', p, 'n', 0), (a, n) -> named_struct('text', regexp_replace(a.text, {alike}, n.new), 'n', a.n + regexp_count(a.text, {alike})))"
    between = F.transform(F.split("text", PATTERN, -1), lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
    df = df.withColumn("between", F.when(F.size("found") > 0, F.when(F.size("names") > 0, F.expr(f"transform(split(text, {quoted(PATTERN)}, -1), p -> {swapped})")).otherwise(between)))
    joined = F.array_join(F.zip_with("between.text", F.col("written"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    n = F.expr("size(filter(found, f -> f.kind IS NOT NULL)) + aggregate(coalesce(between.n, array(0)), 0, (a, b) -> a + b)")
    return df.select("row", text.alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias("n_entities"))


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"row.{quoted_name(c)}").alias(c) for c in names]


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and ``n_entities``, how many places were.

    ``key`` is a secret: the same key gives the same replacements over the same tables. Null texts stay
    null, empty ones empty; repeated rows get the same text; a null doc_id changes nothing, as rows are
    told apart by their text. Other columns stay as they are; a column called n_entities is replaced.
    """
    return replaced(docs, key).select(*unpacked([c for c in docs.columns if c != "n_entities"]), "n_entities")


def without_private(docs: DataFrame, key: str) -> DataFrame:
    """`surrogates` without the count: all columns other than ``text`` as they are."""
    return replaced(docs, key).select(*unpacked(docs.columns))
