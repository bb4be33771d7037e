"""Personal data replaced by keyed surrogates.

Entities are found by one pattern. Each distinct entity, in a normal form, gets a surrogate from a keyed hash: of its
type and format, for names also of its gender and script. Surrogates are checked against each other and against all
entities of the type; on a collision all but one entity draw again, until none is left, so different entities stay
different and no surrogate is somebody else's entity. Entities that a number of draws does not place, because their
format has too few values, draw from a wider format, which grows with every further draw. All mentions of an entity, in whatever notation, get the same
surrogate, written in the notation of the mention.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored

KEY = "replace-me"
MAX_DRAWS = 30

# Titles, given names and syllables.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "Г-жа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Г-н", "Κύριος"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Fiona Gloria Helena Irina Julia Laura Maria Nina Olivia Paula Rosa Sofia",
    ("latin", "m"): "Adam Bruno David Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Oscar Paul Robert Simon",
    ("latin", "n"): "Alex Andrea Chris Dominique Jean Jules Kim Luca Marian Nikola Robin Sascha Sam Toni Vivian Yael",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья Тамара Юлия Яна",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей Тимур Юрий",
    ("cyrillic", "n"): "Валя Женя Саша Шура Паша Слава Рома Миша Ксюша Тоша Луша Даня Сеня Яша Гоша Люся",
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Όλγα Πηνελόπη Ρένα Σοφία Χαρά",
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λεωνίδας Μάρκος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης",
    ("greek", "n"): "Άρη Βάσω Γωγώ Έλλη Ζέτα Θάλεια Κλειώ Λένα Μυρτώ Νανά Ξανθή Πόπη Ρίτα Σάσα Τζένη Φανή",
}
SYLLABLES = {
    "latin": "ba den kor lin mar nes pol rin sal ter vol wen zan dri fel gar",
    "cyrillic": "ба ден кор лин мар нес пол рин сал тер вол вен зан дри фел гар",
    "greek": "βα δεν κορ λιν μαρ νες πολ ριν σαλ τερ βολ γεν ζαν δρι φελ γαρ",
}
ALPHABETS = {
    r"\p{IsCyrillic}": ("абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    r"\p{IsGreek}": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    r"\p{L}": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True)) + r")\.?"
# Possessive repeats, which Java matches in a loop: labels up to the last one that a label of letters follows.
_LABEL = r"[\p{L}\p{N}-]++\."
EMAIL = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@"
    rf"(?:(?:{_LABEL}(?!\p{{L}}{{2}}))*+{_LABEL}(?=\p{{L}}{{2}}))++\p{{L}}{{2,}}+"
)
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# 16 digits in fours are a card whatever their check digit; other lengths and groups are candidates that need a valid one.
_CARDS = (r"\d{4}(?<gap>[ -]?)\d{4}\k<gap>\d{4}\k<gap>\d{4}", r"\d{13,19}", r"\d{4}(?<five>[ -])\d{6}\k<five>\d{4,5}",
          r"\d{4}(?<six>[ -])\d{4}\k<six>\d{4}\k<six>\d{4}\k<six>\d{1,3}")
CARD = rf"(?<!\d)(?:{_CARDS[3]}|{_CARDS[0]}|{_CARDS[2]}|{_CARDS[1]})(?!\d)"
SOCIAL = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
# International numbers of 7 to 15 digits, of known length where the country's is fixed; 3-3-4; national ones with a 0.
_SEP = r"[ .()/-]{0,2}"
_ABROAD = rf"(?:1(?:{_SEP}\d){{10}}|3[34](?:{_SEP}\d){{9}}|44(?:{_SEP}\d){{10}}|\d(?:{_SEP}\d){{6,14}})"
PHONE = (
    rf"(?<![\d+])(?:(?:\+|00(?=[1-9])){_ABROAD}|(?:\+\d{{1,3}}[ .-]?)?\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}"
    r"|0\d(?<pair>[ .-])\d\d(?:\k<pair>\d\d){3}|\(?0\d{1,4}\)?[ /-]\d{3,4}[ -]?\d{3,5})(?!\d)"
)
NAME = rf"(?<!\p{{L}}){_TITLE} \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
ENTITY = "|".join((EMAIL, IP, IBAN, CARD, SOCIAL, PHONE, NAME))
# Every entity has an at sign, a digit or a title.
HINT = rf"[@\p{{Nd}}]|{_TITLE} "


def _kind(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLE}) ", 1)
    gender = F.when(F.rtrim(F.translate(title, ".", "")).isin(TITLES["f"]), "f")
    gender = gender.when(F.translate(title, ".", "").isin(TITLES["m"]), "m").otherwise("n")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(m.rlike(rf"^{_CARDS[0]}$"), "card")
        .when(m.rlike(rf"^(?:{_CARDS[1]}|{_CARDS[2]}|{_CARDS[3]})$"), F.when(_check_sum(F.regexp_replace(m, "[ -]", "")) % 10 == 0, "card"))
        .when(title == "", "phone")
        .otherwise(F.concat(F.lit("name_"), gender))
    )


def _normal(kind: Column, m: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind.startswith("name"), F.regexp_replace(m, rf"^{_TITLE} ", ""))
        .otherwise(F.regexp_replace(m, r"\D", ""))
    )


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(key), *parts), 512)


def _number(digest: Column, i) -> Column:
    """The i-th byte of a 128-digit hash; after the 60th the bytes come again."""
    at = i % 60 * 2 + 1
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(digest.substr(at, F.lit(4)), 16, 10).cast("int")


def _pick(words: str, digest: Column, i) -> Column:
    every = words.split()
    return F.get(F.array(*map(F.lit, every)), _number(digest, i) % len(every))


def _like(s: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case and script; all else as it is."""

    def one(c: Column, i: Column, d: Column) -> Column:
        n = _number(d, i)
        out = F.when(c.rlike(r"^\d$"), (n % 10).cast("string"))
        for pattern, (lower, upper) in ALPHABETS.items():
            small, large = (F.substring(F.lit(a), n % len(a) + 1, F.lit(1)) for a in (lower, upper))
            out = out.when(c.rlike(f"^{pattern}$"), F.when(c.rlike(r"^\p{Lu}$"), large).otherwise(small))
        return out.otherwise(c)

    def every(d: Column) -> Column:
        return F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, i, d)), "")

    # The hash is bound to a variable, so that it is not worked out again for every character.
    return F.get(F.transform(F.array(digest), every), F.lit(0))


def _check_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )


def _more(alphabet: str, digest: Column, wide: Column) -> Column:
    """``wide`` characters, none for 0."""
    every = " ".join(alphabet)
    at = F.when(wide > 0, F.sequence(F.lit(0), wide - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: _pick(every, digest, 59 - i)), "")


def _card(s: Column, digest: Column, wide: Column) -> Column:
    """Keeps the first digit, and a valid check digit valid."""
    drawn = F.concat(s.substr(1, 1), _like(F.substring(s, F.lit(2), F.length(s) - 2), digest), _more("0123456789", digest, wide))
    valid = ((10 - _check_sum(F.concat(drawn, F.lit("0"))) % 10) % 10).cast("string")
    free = (_number(digest, 40) % 10).cast("string")
    return F.concat(drawn, F.when(_check_sum(s) % 10 == 0, valid).otherwise(free))


def _address(s: Column, digest: Column, wide: Column) -> Column:
    """Private ranges stay private; others become public addresses.

    Wider: private ones leave their range for 10.0.0.0/8, then all go to the reserved 240.0.0.0/4, then to unique local
    IPv6 addresses.
    """
    parts = [_number(digest, i) for i in range(0, 8, 2)]
    low, last = (parts[2] % 256).cast("string"), (parts[3] % 254 + 1).cast("string")
    second = (parts[1] % 256).cast("string")
    first = (
        F.when(s.startswith("10."), F.concat(F.lit("10."), second))
        .when(s.startswith("192.168."), F.lit("192.168"))
        .when(s.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat(F.lit("172."), (parts[1] % 16 + 16).cast("string")))
        .otherwise(F.concat((parts[0] % 110 + 11).cast("string"), F.lit("."), second))
    )
    private = s.rlike(r"^(10|192\.168|172\.(1[6-9]|2\d|3[01]))\.")
    first = (
        F.when((wide == 1) & private, F.concat(F.lit("10."), second))
        .when(wide > 0, F.concat((parts[0] % 15 + 240).cast("string"), F.lit("."), second))
        .otherwise(first)
    )
    local = F.concat_ws(":", F.concat(F.lit("fd"), digest.substr(1, 2)), *(digest.substr(i, 4) for i in range(3, 31, 4)))
    return F.when(wide > 2, local).otherwise(F.concat_ws(".", first, low, last))


def _mail(s: Column, digest: Column, key: str, wide: Column) -> Column:
    """One surrogate domain for each domain, whatever the mailbox; the last label stays. Wider: a longer mailbox."""
    domain = F.regexp_extract(s, r"@(.*)\.[^.]*$", 1)
    return F.concat(
        _like(F.substring_index(s, "@", 1), digest), _more(ALPHABETS[r"\p{L}"][0], digest, wide), F.lit("@"), _like(domain, _hash(key, F.lit("domain"), domain)),
        F.lit("."), F.substring_index(s, ".", -1),
    )


def _name(s: Column, digest: Column, kind: Column, draw: Column) -> Column:
    """A given name of the gender and script, and a family name that gets longer with every draw."""
    script = F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.substring_index(kind, "_", -1)
    given = reduce(
        lambda out, g: out.when((script == g[0]) & (gender == g[1]), _pick(GIVEN[g], digest, 20)),
        GIVEN,
        F.when(F.lit(False), ""),
    )
    family = reduce(
        lambda out, k: out.when(
            script == k,
            F.initcap(
                F.array_join(F.transform(F.sequence(F.lit(0), draw + 2), lambda i: _pick(SYLLABLES[k], digest, i)), "")
            ),
        ),
        SYLLABLES,
        F.when(F.lit(False), ""),
    )
    return F.when(F.contains(s, F.lit(" ")), F.concat_ws(" ", given, family)).otherwise(family)


def _surrogate(kind: Column, s: Column, draw: Column, key: str, own_draws: int) -> Column:
    """Draws from ``own_draws`` on are from wider formats, each at least ten times the last."""
    wide = F.greatest(draw - own_draws + 1, F.lit(0))
    digest = _hash(key, kind, s, draw.cast("string"))
    keep = F.when(kind == "iban", 2).when(kind == "phone", F.greatest(F.length(s) - 10, F.lit(0))).otherwise(0)
    plain = F.concat(
        F.substring(s, F.lit(1), keep), _like(F.substring(s, keep + 1, F.length(s)), digest), _more("0123456789", digest, wide)
    )
    return (
        F.when(kind == "email", _mail(s, digest, key, wide))
        .when(kind == "ip", _address(s, digest, wide))
        .when(kind == "card", _card(s, digest, wide))
        .when(kind.startswith("name"), _name(s, digest, kind, draw))
        .otherwise(plain)
    )


def draw_surrogates(entities: DataFrame, key: str, max_draws: int = MAX_DRAWS) -> DataFrame:
    """kind, normal, surrogate of every distinct entity (kind, normal); distinct within a type and no entity itself.

    Entities without a place after ``max_draws`` draws in their own format get one in a wider format.
    """
    # Names of all genders share one space, so that different people stay different.
    space = F.substring_index("kind", "_", 1).alias("space")
    names = entities.select(space, F.col("normal").alias("surrogate"), F.lit(True).alias("taken")).distinct()
    held = entities.withColumn("draw", F.lit(0))
    own = F.struct("normal", "kind")
    while True:
        held = stored(
            held.select("kind", "normal", "draw").withColumn(
                "surrogate", _surrogate(F.col("kind"), F.col("normal"), F.col("draw"), key, max_draws)
            ),
            "surrogates",
        )
        owners = held.groupBy(space, "surrogate").agg(F.min(own).alias("owner"), F.count("*").alias("n"))
        clashes = owners.join(names, ["space", "surrogate"], "left").where("n > 1 OR taken")
        if clashes.isEmpty():
            return held.drop("draw")
        again = F.coalesce(F.col("taken"), F.lit(False)) | (own != F.coalesce("owner", own))
        held = held.withColumn("space", space).join(clashes, ["space", "surrogate"], "left").withColumn("draw", F.col("draw") + again.cast("int"))


def _written(m: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the notation of the mention; what a wider one has more follows at the end."""

    def put(acc: Column, c: Column) -> Column:
        slot = c.rlike(r"^[A-Z0-9]$")
        return F.struct(
            (acc["i"] + slot.cast("int")).alias("i"),
            F.concat(acc["out"], F.when(slot, surrogate.substr(acc["i"], F.lit(1))).otherwise(c)).alias("out"),
        )

    poured = F.aggregate(
        F.split(m, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), put,
        lambda acc: F.concat(acc["out"], surrogate.substr(acc["i"], F.length(surrogate))),
    )
    shouted = (F.upper(m) == m) & (F.lower(m) != m)
    return (
        F.when(kind == "email", F.when(shouted, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "ip", surrogate)
        .when(kind.startswith("name"), F.concat(F.regexp_extract(m, rf"^{_TITLE} ", 0), surrogate))
        .otherwise(poured)
    )


def replace_personal_data(docs: DataFrame, key: str = KEY, count_as: str = "n_entities") -> DataFrame:
    """All columns of ``docs`` (text, any others) with the text's entities replaced, and ``count_as``, their number.

    Null and empty texts stay as they are, with 0. Equal texts give equal texts, whatever their doc_id. Columns of
    ``docs`` may have any names but that of ``count_as``.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    # One pass over the texts: every later step reads the matches, and the text between them, from the stored rows.
    scanned = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", found.alias("found"))
    rows = stored(
        scanned.select(
            "row", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "found",
            F.when(F.size("found") > 0, F.split("text", ENTITY, -1)).alias("gaps"),
        ),
        "scanned",
    )
    has = rows.where("size(found) > 0")
    mention = F.col("mention")
    mentions = stored(
        has.select("k1", "k2", F.explode("found").alias("mention"))
        .distinct()
        .withColumn("kind", _kind(mention))
        .where("kind IS NOT NULL")
        .withColumn("normal", _normal(F.col("kind"), mention)),
        "mentions",
    )
    surrogates = draw_surrogates(stored(mentions.select("kind", "normal").distinct(), "entities"), key)
    written = mentions.join(surrogates, ["kind", "normal"]).select(
        "k1", "k2", F.struct("mention", _written(mention, F.col("kind"), F.col("surrogate")).alias("new")).alias("pair")
    )
    maps = stored(written.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list("pair")).alias("new")), "maps")
    pieces = F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: F.concat(F.coalesce(F.try_element_at("new", F.get("found", i - 1)), F.get("found", i - 1)), F.get("gaps", i)))
    n = F.size(F.filter("found", lambda m: F.coalesce(F.map_contains_key("new", m), F.lit(False)))).cast("long")
    changed = has.join(maps, ["k1", "k2"], "left").select(
        "row", F.concat(F.get("gaps", F.lit(0)), F.array_join(pieces, "")).alias("new_text"), n.alias("n")
    )
    same = rows.where("NOT coalesce(size(found), 0) > 0").select("row", F.col("row.text").alias("new_text"), F.lit(0).cast("long").alias("n"))
    return same.unionByName(changed).select(
        *(F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns),
        F.col("n").alias(count_as),
    )
