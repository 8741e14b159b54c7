"""Personal data and secrets replaced by surrogates.

One pattern finds the entities: e-mail addresses, telephone numbers, card numbers, IP
addresses, keys and tokens, and persons named after a title. Names of a person found so are replaced
wherever they stand in that text, with a title or without. Every entity is brought to a
canonical form, so that its mentions share one surrogate in the whole corpus, and the surrogate is
drawn from a keyed hash of it: it keeps the type, the script of letters, upper and lower
case, the number and grouping of digits, the gender a title tells, the country code of a number,
the ending of a domain and whether a card number passes its check digit. The name before an e-mail's sign and the domain
behind it have surrogates of their own, so addresses of one domain stay together.

Surrogates are checked for collisions: with each other (distinct entities stay
distinct) and with entities that occur (nobody is given another's data). Of colliding
entities the first in order keeps its surrogate, the others draw again with the next counter, until
none collides. Formats can be too small for all their entities, so after `WIDEN` draws each further
one makes room: names grow by syllables, numbers and keys by digits, and the parts of an address to three
digits, then by a part that no address has. So the draws end, however few surrogates a format has.

Everything is DataFrame functions. Every text is searched once, behind a cheap look for a hint of an
entity, and written with what was found; texts without entities are not shuffled.

Results for odd rows: a NULL text stays NULL and an empty one empty, with no entities; repeated
rows give equal rows; an empty table gives an empty table. All columns are kept; `n_chars` is
counted anew where the text changed, and `n_entities` is added (a column of that name is replaced).
Very long texts are searched whole; their entities are one row's array.

Not found: persons who are named without a title in the whole text, numbers written in a national form
without area brackets, IBANs, IPv6 addresses, key blocks and secrets announced in prose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sittings.runtime import discard, settle

KEY = "replace this key"
WIDEN = 6

# Titles, and given names by gender and script.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "Signor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа"]
NEUTRAL_TITLES = ["Dr", "Prof", "Doctor", "Professor", "Доктор", "Профессор"]
GIVEN = {
    "male latin": ["Adrian", "Albert", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Hugo", "Leon", "Martin", "Max", "Oscar", "Paul", "Simon"],
    "female latin": ["Alice", "Anna", "Bianca", "Clara", "Diana", "Elena", "Emma", "Eva", "Julia", "Laura", "Lena", "Maria", "Nina", "Nora", "Sofia", "Vera"],
    "neutral latin": ["Alex", "Chris", "Kim", "Luca", "Noel", "Robin", "Sam", "Toni"],
    "neutral cyrillic": ["Женя", "Саша", "Слава", "Шура"],
    "male cyrillic": ["Алексей", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Роман"],
    "female cyrillic": ["Алина", "Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve",
    "cyrillic": "ба бе бо ва ве да де до за зе ка ко ла ле ло ма ме мо на не но па ро са се со та те то",
}

TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
TITLE = rf"(?:{'|'.join(TITLES)})\.? "
# A name goes on after hyphens and apostrophes, but not with the 's of a genitive.
NAME = (
    r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]))(?:[-'’](?![sS](?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
)
# What stands before a secret and is kept; a longer name may end in the keyword (access_token).
LABEL = r"(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\"']?"

# What an entity is by itself, in the order in which types are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}])(?<![\p{L}\p{M}\p{N}][._%+-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*+"
    r"@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": rf"{LABEL}[A-Za-z0-9+/_.=~-]{{7,}}[A-Za-z0-9+/_=~-]"
    r"|(?<![\p{IsLatin}0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{IsLatin}0-9])"
    r"|(?i:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}+"
    r"|(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![\p{IsLatin}0-9]))",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])",
    "phone": r"(?<![\d.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "person": rf"(?<!\p{{L}}){TITLE}{NAME}(?: (?!{TITLE}\p{{Lu}}){NAME})*+",
}
INITIALS = "".join(sorted({t[0] for t in TITLES}))


def _one_of(*names: str) -> str:
    return "(?:" + "|".join(f"(?:{PATTERNS[n]})" for n in names) + ")"


# Numbers are tried only where a digit or its sign stands, the others where they can begin.
ANY = (
    rf"(?=[\p{{L}}\p{{N}}])(?:{PATTERNS['email']})|(?=[A-Za-z0-9]){_one_of('secret')}"
    rf"|(?=[{INITIALS}]){_one_of('person')}|(?=[0-9+(]){_one_of('ip', 'ssn', 'card', 'phone')}"
)

# A text without any of this holds no entity; far cheaper to look for.
HINT = (
    r"[0-9@=]|[dtnyDTNY] ?:|(?i:sk|pk|ghp|gho|xox[bp])[-_]|A[KS]IA"
    rf"|(?=[{INITIALS}]){TITLE}"
)


def _kind(raw: Column) -> Column:
    """The first type whose pattern the whole entity is."""
    kind = F.lit("secret")
    for name in reversed(PATTERNS):
        kind = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _parts(raw: Column, kind: Column) -> Column:
    """The pieces of an entity that get surrogates: kind, canonical form, text before, own text."""
    words = F.split(raw, " ")

    def titled(titles: list[str]) -> Column:
        return raw.rlike("^(?:" + "|".join(titles) + r")\.? ")

    gender = F.when(titled(FEMALE_TITLES), "female").when(titled(NEUTRAL_TITLES), "neutral").otherwise("male")
    title = F.concat(words[0], F.lit(" "))

    def part(kind: Column, canonical: Column, before: Column, own: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"), before.alias("before"), own.alias("own"))

    def given(word: Column, i: Column) -> Column:
        name = F.concat_ws(" ", F.lit("given"), gender, _script(word))
        return part(name, F.lower(word), F.when(i == 0, title).otherwise(" "), word)

    family_word = F.element_at(words, -1)
    name = F.concat_ws(" ", F.lit("family"), _script(family_word))
    family = part(name, F.lower(family_word), F.when(F.size(words) > 2, " ").otherwise(title), family_word)
    # The last name is the family's; none stands before it after a title alone.
    names = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    person = F.concat(F.transform(names, given), F.array(family))
    sides = F.split(raw, "@")
    address = F.array(
        part(F.lit("mailbox"), F.lower(sides[0]), F.lit(""), sides[0]),
        part(F.lit("domain"), F.lower(sides[1]), F.lit("@"), sides[1]),
    )
    digits = F.regexp_replace(raw, r"\D", "")
    label = rf"^({LABEL})?(.*)$"
    value = F.regexp_extract(raw, label, 2)
    # A hex key is the same key in upper case.
    secret = F.when(value.rlike("^[0-9A-F]{16,}$"), F.lower(value)).otherwise(value)
    numbers = kind.isin("card", "phone", "ssn")
    canonical = F.when(numbers, digits).when(kind == "secret", secret).otherwise(raw)
    # A number's country code belongs to its format: it is kept.
    code = F.regexp_extract(raw, r"^\+(\d{1,3})", 1)
    # Without a separator behind it the code's length is not known; one digit is kept.
    code = F.when(raw.rlike(r"^\+\d{4}"), F.substring(code, 1, 1)).otherwise(code)
    name = F.when(kind == "phone", F.concat(F.lit("phone "), code)).otherwise(kind)
    before = F.when(kind == "secret", F.regexp_extract(raw, label, 1)).otherwise("")
    whole = F.array(part(name, canonical, before, F.when(kind == "secret", value).otherwise(raw)))
    return F.when(kind == "person", person).when(kind == "email", address).otherwise(whole)


def _number(digest: Column, at: Column | int, modulus: int) -> Column:
    """A number below `modulus` from the 32 bits at a place of the digest."""
    place = (F.lit(at) if isinstance(at, int) else at) * 8 + 1
    return F.pmod(F.conv(F.substr(digest, place, F.lit(8)), 16, 10).cast("long"), F.lit(modulus))


# Letters and digits of surrogates for characters of each kind, in the order in which kinds are tried.
ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"),
    (r"\p{IsLatin}", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"),
    (r"\p{IsHan}", "天地人山水火木金土日月星雨雪春夏秋冬東西南北上下左右大小中田林森花草石竹米"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{N}", "0123456789"),
    (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{M}", "\u0300\u0301\u0302\u0303\u0308"),
]
MARK = 0xE000  # the first character of a private range, one for each alphabet


def _kinds(text: Column) -> Column:
    """The alphabet of each character, by its number; others are out of range."""
    for i, (pattern, _) in enumerate(ALPHABETS):
        text = F.regexp_replace(text, pattern, chr(MARK + i))
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - MARK)


def _characters(chars: Column, kinds: Column, hexadecimal: Column, digest: Column, keep: Column) -> Column:
    """Digits for digits and letters for letters of the script and case, after `keep` characters."""
    alphabets = F.array(*[F.lit(a) for _, a in ALPHABETS])
    sizes = F.array(*[F.lit(len(a)) for _, a in ALPHABETS])

    def one(kind: Column, i: Column) -> Column:
        # 32 bits a character from a digest of its own, drawn from the entity's.
        own = F.conv(F.substr(F.md5(F.concat_ws("|", digest, i.cast("string"))), F.lit(1), F.lit(8)), 16, 10)
        size = F.when(hexadecimal & kind.isin(1, 2), 6).otherwise(F.get(sizes, kind))
        drawn = F.substr(F.get(alphabets, kind), (F.pmod(own.cast("long"), size) + 1).cast("int"), F.lit(1))
        return F.when((i >= keep) & kind.between(0, len(ALPHABETS) - 1), drawn).otherwise(F.get(chars, i))

    return F.array_join(F.transform(kinds, one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a card number modulo 10."""
    ordered = F.reverse(F.split(digits, ""))

    def one(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + F.pmod(i, F.lit(2)))
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(F.aggregate(F.transform(ordered, one), F.lit(0), lambda a, b: a + b), F.lit(10))


def _syllable(digest: Column, pool: Column, n: int):
    def one(i: Column) -> Column:
        own = F.md5(F.concat_ws("|", digest, i.cast("string")))
        return F.element_at(pool, (_number(own, 0, n) + 1).cast("int"))

    return one


def _name(kind: Column, digest: Column, draw: Column) -> Column:
    """A given or family name of the script; later draws lengthen it by syllables."""
    out = F.lit("")
    for script, syllables in SYLLABLES.items():
        pool = syllables.split(" ")
        array = F.array(*[F.lit(s) for s in pool])
        count = F.lit(3) + F.greatest(draw - WIDEN, F.lit(0))
        steps = F.sequence(F.lit(0), count - 1)
        made = F.array_join(F.transform(steps, _syllable(digest, array, len(pool))), "")
        out = F.when(kind.endswith(script), F.initcap(made)).otherwise(out)
    for group, names in GIVEN.items():
        array = F.array(*[F.lit(n) for n in names])
        at = (_number(digest, 0, len(names)) + 1).cast("int")
        # A few dozen names serve the first draws, syllables are added after that.
        tail = F.when(draw > 1, F.lower(out)).otherwise("")
        given = F.concat(F.element_at(array, at), tail)
        out = F.when(kind == f"given {group}", given).otherwise(out)
    return out


def _octets(canonical: Column, digest: Column, draw: Column) -> Column:
    """An address whose parts have as many digits as before, or three after `WIDEN` draws; a further
    part, which no address has, after as many again."""

    def one(part: Column, i: Column) -> Column:
        own = F.md5(F.concat_ws("|", digest, i.cast("string")))
        return (
            F.when((F.length(part) == 1) & (draw <= WIDEN), _number(own, 0, 9) + 1)
            .when((F.length(part) == 2) & (draw <= WIDEN), _number(own, 0, 90) + 10)
            .otherwise(_number(own, 0, 155) + 100)
            .cast("string")
        )

    made = F.array_join(F.transform(F.split(canonical, r"\."), one), ".")
    return F.when(draw <= 2 * WIDEN, made).otherwise(F.concat(made, F.lit("."), _number(digest, 1, 1 << 31).cast("string")))


def with_surrogate(parts: DataFrame, draw: int, key: str) -> DataFrame:
    """`parts` (kind, canonical) with the surrogate of this draw.

    Made in steps, each of which names what the next ones use several times.
    """
    kind, canonical, digest, drawn = (F.col(c) for c in ("kind", "canonical", "digest", "drawn"))
    number = F.lit(draw)
    ending = F.when(kind == "domain", F.regexp_extract(canonical, r"\.[^.]*$", 0)).otherwise("")
    prefixed = (kind == "secret") & canonical.rlike("^(AKIA|ASIA)")
    code = F.length(F.regexp_extract(kind, r"^phone (\d*)", 1))
    keep = F.when((kind == "card") | prefixed, 4).when(kind.startswith("phone"), code).otherwise(0)
    steps = parts.select("kind", "canonical").withColumns(
        {
            "digest": F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, number.cast("string")), 256),
            "ending": ending,
            "keep": keep,
            "hexadecimal": canonical.rlike("^[0-9A-Fa-f]{16,}$"),
        }
    )
    changed = F.substr(canonical, F.lit(1), F.length(canonical) - F.length("ending"))
    steps = steps.withColumns({"chars": F.split(changed, ""), "kinds": _kinds(changed)})
    made = _characters(*(F.col(c) for c in ("chars", "kinds", "hexadecimal", "digest", "keep")))
    steps = steps.withColumn("drawn", made)
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.pmod(_luhn(canonical) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    digits = F.regexp_replace(F.sha2(digest, 256), "[a-f]", "")
    extra = F.substring(digits, 1, min(20, max(0, draw - WIDEN)))
    shown = (
        F.when(kind == "ip", _octets(canonical, digest, number))
        .when(kind == "card", F.concat(body, last.cast("string"), extra))
        .when(kind.startswith("given") | kind.startswith("family"), _name(kind, digest, number))
        .when(kind.isin("mailbox", "domain"), F.concat(extra, drawn, F.col("ending")))
        .otherwise(F.concat(drawn, extra))
    )
    return steps.select("kind", "canonical", shown.alias("surrogate"))


def _type(kind: Column) -> Column:
    """What must stay distinct: numbers of all countries together, names by their part."""
    return F.split(kind, " ")[0]


def assign(parts: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canonical and surrogate, free of collisions, for distinct (kind, canonical)."""
    real = settle(parts.select("kind", "canonical").distinct(), "parts")
    taken = real.select(_type(F.col("kind")).alias("type"), F.col("canonical").alias("shown")).distinct()
    waiting, done, draw = real, None, 0
    while True:
        drawn = with_surrogate(waiting, draw, key).withColumn("type", _type(F.col("kind")))
        # Read twice: the long expressions behind a draw are planned and worked out once.
        drawn = settle(drawn.withColumn("shown", F.lower("surrogate")), "drawn")
        first = drawn.groupBy("type", "shown").agg(F.min(F.struct("kind", "canonical")).alias("first"))
        free = drawn.join(first, ["type", "shown"]).filter(
            F.struct("kind", "canonical") == F.col("first")
        )
        free = free.join(taken.withColumn("shown", F.lower("shown")), ["type", "shown"], "left_anti")
        if done is not None:
            used = done.select("type", "shown")
            free = free.join(used, ["type", "shown"], "left_anti")
        free = settle(free.select("type", "shown", "kind", "canonical", "surrogate"), "surrogates")
        done = free if done is None else done.unionAll(free)
        left = settle(waiting.join(free, ["kind", "canonical"], "left_anti"), "waiting")
        discard(drawn)
        if draw:
            discard(waiting)
        waiting, draw = left, draw + 1
        if waiting.isEmpty():
            discard(real, waiting)
            return done.select("kind", "canonical", "surrogate")


def _shown(kind: Column, own: Column, before: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention: its grouping of digits, its case."""
    marks = F.split(own, "")
    # Digits go into the mention's pattern in order; what is left over follows.
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    filled = F.aggregate(
        marks,
        start,
        lambda a, c: F.when(
            c.rlike("[0-9]"),
            F.struct(
                F.concat(a["out"], F.substr(surrogate, a["next"], F.lit(1))).alias("out"),
                (a["next"] + 1).alias("next"),
            ),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["next"].alias("next"))),
    )
    grouped = F.concat(filled["out"], F.substr(surrogate, filled["next"], F.length(surrogate)))
    cased = F.array_join(
        F.transform(
            F.split(surrogate, ""),
            lambda c, i: F.when(F.get(marks, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c),
        ),
        "",
    )
    upper = own.rlike("^[0-9A-F]{16,}$") & (kind == "secret")
    numbers = kind.isin("card", "ssn") | kind.startswith("phone")
    shown = F.when(numbers, grouped).when(kind.isin("mailbox", "domain"), cased)
    return F.concat(before, shown.when(upper, F.upper(surrogate)).otherwise(surrogate))


# A name by itself, not part of a longer word.
ALONE = (r"(?<![\p{L}\p{M}\p{N}])(?:", r")(?![\p{L}\p{M}\p{N}])")


def _named(text: Column, names: Column) -> Column:
    """The text with each of `names` (name and surrogate, longest first) replaced where it stands alone."""

    def one(out: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(ALONE[0]), name["name"], F.lit(ALONE[1]))
        return F.regexp_replace(out, pattern, name["surrogate"])

    return F.aggregate(names, text, one)


def _mentions(text: Column, names: Column) -> Column:
    pattern = F.concat(F.lit(ALONE[0]), F.array_join(names["name"], "|"), F.lit(ALONE[1]))
    return F.when(F.size(names) > 0, F.regexp_count(text, pattern)).otherwise(0)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The rows with entities in `text` replaced, and `n_entities`."""
    columns = [c for c in docs.columns if c != "n_entities"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0))
    searched = docs.select(row, found.alias("raw"))
    searched = settle(searched.withColumn("raw", F.when(F.size("raw") > 0, F.col("raw"))), "searched")

    own_text = F.col("row")["text"].cast("string")
    touched = searched.filter("raw IS NOT NULL").withColumn("key", F.xxhash64(own_text))
    entities = settle(touched.select("key", "raw").dropDuplicates(["key"]), "entities")
    mentions = entities.select("key", F.posexplode("raw").alias("at", "raw"))
    distinct = mentions.select("raw").distinct().withColumn("kind", _kind(F.col("raw")))
    parts = distinct.select("raw", F.posexplode(_parts(F.col("raw"), F.col("kind"))).alias("n", "part"))
    parts = settle(parts.select("raw", "n", "part.*"), "entity-parts")
    given = assign(parts, key)
    piece = _shown(F.col("kind"), F.col("own"), F.col("before"), F.col("surrogate"))
    pieces = F.array_sort(F.collect_list(F.struct("n", piece.alias("piece"))))
    is_name = F.col("kind").startswith("given") | F.col("kind").startswith("family")
    size = -F.length("own")
    name = F.when(is_name, F.struct(size.alias("size"), F.col("own").alias("name"), "surrogate"))
    shown = parts.join(given, ["kind", "canonical"]).groupBy("raw").agg(
        F.array_join(pieces["piece"], "").alias("shown"), F.collect_set(name).alias("names")
    )
    by_text = F.array_sort(F.collect_list(F.struct("at", "shown")))["shown"].alias("shown")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")
    replaced = settle(mentions.join(shown, "raw").groupBy("key").agg(by_text, names), "replacements")
    discard(parts, entities)

    between = F.split(own_text, ANY, -1)
    joined = F.transform(
        between, lambda t, i: F.concat(_named(t, F.col("names")), F.coalesce(F.get("shown", i), F.lit("")))
    )
    more = F.aggregate(between, F.lit(0), lambda n, t: n + _mentions(t, F.col("names")))
    changed = touched.join(replaced, "key").select(
        "row", F.array_join(joined, "").alias("now"), (F.size("shown") + more).cast("long").alias("n_entities")
    )
    none = F.lit(0).cast("long").alias("n_entities")
    same = searched.filter("raw IS NULL").select("row", own_text.alias("now"), none)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("now").alias("text")
        field = F.col("row")[name]
        if name == "n_chars":
            changed_length = F.length("now").cast("long")
            field = F.when(F.col("n_entities") > 0, changed_length).otherwise(field)
        return field.alias(name)

    out = changed.unionAll(same)
    return out.select(*[column(c) for c in columns], "n_entities")
