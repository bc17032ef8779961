"""Surrogates for personal data, with column functions only.

Entities are found by pattern and proved where they carry a check digit. Each gets a
replacement that a keyed digest of its canonical form decides: the same entity reads the same
in every document, its written form (separators, brackets, case, title) stays, and the kind
holds (cards pass the Luhn check, IBANs the check modulo 97, names keep script and gender).
Every part of a name is an entity of its own, so that two people never share a full name. A name
is what follows a title: any number of capitalised words, with apostrophes, hyphens, initials
and particles; the last word is the family name. Where a document has a titled name, its parts
are replaced wherever they stand in it, in any case. Particles stay.

Replacements are checked over the whole corpus: two entities never share one, and none is an
entity that occurs. Those that clash draw again; only they are joined to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, store

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


@dataclass(frozen=True)
class Names:
    """Titles before a name, for women, for men and for anyone, and the particles within one."""

    titles_f: tuple[str, ...] = ("Mrs", "Ms", "Miss", "Mlle", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra", "Госпожа", "Κυρία")
    titles_m: tuple[str, ...] = ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
    titles_u: tuple[str, ...] = ("Dr", "Doctor", "Prof", "Professor", "Mx")
    particles: tuple[str, ...] = ("von", "vom", "van", "der", "den", "ter", "zu", "zur", "de", "del", "della", "di", "da", "dos", "du", "des", "la", "le", "las", "los", "al", "el", "bin", "ibn", "y")

    @staticmethod
    def _one(words: tuple[str, ...]) -> str:
        return "|".join(sorted(words, key=len, reverse=True))

    @property
    def title(self) -> str:
        one = rf"(?:{self._one(self.titles_f + self.titles_m + self.titles_u)})\.?\x20"
        return rf"(?:{one})+"

    @property
    def person(self) -> str:
        particles = rf"(?:(?:{self._one(self.particles)})\x20){{0,3}}"
        part = rf"{particles}(?:(?:\p{{Lu}}\.)+|{_CAPITALISED}(?:-{_CAPITALISED})*)"
        return rf"(?<!\p{{L}}){self.title}{part}(?:\x20{part})*"

    @property
    def entity(self) -> str:
        return "|".join((_EMAIL, _IBAN, _CARD, _IP, _SSN, _PHONE, self.person))

    @property
    def cue(self) -> str:
        """A text without a match of this holds no entity."""
        return f"[0-9@]|{self.title}"

    def gender(self, hit: Column) -> Column:
        said = lambda titles: hit.rlike(rf"^(?:{self._one(titles)})\.?\x20")
        return F.when(said(self.titles_f), "f").when(said(self.titles_m), "m").otherwise("u")

    def parts(self, hit: Column) -> Column:
        """``text, kind`` of the words of a titled name; kind ``''`` for what stays."""
        words = F.split(F.regexp_replace(hit, f"^{self.title}", ""), " ")
        given = F.concat(F.lit("given_"), self.gender(hit))

        def of_word(word: Column, i: Column) -> Column:
            kind = F.when(i == F.size(words) - 1, "person").otherwise(given)
            kind = F.when(word.isin(*self.particles), "").otherwise(kind)
            single = lambda t: F.when(F.char_length(t) == 1, F.when(kind == "", "").otherwise("initial")).otherwise(kind)
            return F.transform(F.regexp_extract_all(word, F.lit(_NAME_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("text"), single(t).alias("kind")))

        return F.flatten(F.transform(words, of_word))


# A capitalised word with apostrophes, such as O'Brien or d'Artagnan, and the letters of a name.
_CAPITALISED = r"(?:\p{Ll}['’])?\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)*+"
_NAME_TOKEN = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"
NAMES = Names()
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = (
    r"(?<![\d+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|\(\d{2,4}\)[ ]?\d{3,4}[ -]\d{3,4}|\d{3}-\d{3}-\d{4})(?!\d)"
)

# A part of a name that is a given name is another entity for each gender.
GIVEN_KINDS = ("given_f", "given_m", "given_u")
KINDS = ("email", "iban", "card", "ip", "ssn", "phone", "person", *GIVEN_KINDS)
DEFAULT_KEY = "surrogates-1"
# Draws of a number that keep its length; each later one is a digit longer.
SAME_LENGTH = 8

# Parts of the names to draw, by script; given names end by gender, and none ends like a family name.
SYLLABLES = {
    "latin": "ba be bo da do el fa ga ha ka ke la le lo ma me mi na ne no ra re ri ro sa se ta te to va ve wi".split(),
    "cyrillic": "ба бо ва ве га да де за ка ко ла ле ма ми на но па ра ре ро са се та то".split(),
    "greek": "βα γα δα ζα θα κα κο λα λε μα μι να νο πα ρα ρο σα σε τα το".split(),
}
NAME_END = {
    "person": {"latin": "nell", "cyrillic": "енко", "greek": "κης"},
    "given_f": {"latin": "lia", "cyrillic": "лия", "greek": "λια"},
    "given_m": {"latin": "rian", "cyrillic": "слав", "greek": "νος"},
    "given_u": {"latin": "sil", "cyrillic": "сим", "greek": "ρις"},
}


def _digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canonical), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` (wrapping after 31) of a digest in hex."""
    return F.conv(F.substr(digest, i % 31 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digits(digest: Column, n: Column) -> Column:
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (_byte(digest, i) % 10).cast("string"))
    return F.when(n > 0, F.array_join(drawn, "")).otherwise(F.lit(""))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _redrawn(text: Column, digest: Column) -> Column:
    """Letters and digits of a lower-case ASCII text drawn anew in place."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char((b % 26 + 97).cast("long")))
            .when(c.rlike("[A-Z]"), F.char((b % 26 + 65).cast("long")))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn_digit(body: Column) -> Column:
    """The digit that completes ``body`` to a valid number."""
    m = F.length(body)

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((m - 1 - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(_chars(body), weighed), F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        value = F.ascii(c) - F.when(digit, 48).otherwise(55)
        return (a * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(_chars(text), F.lit(0), step)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def kind_of(hit: Column) -> Column:
    """The kind of a match of the pattern; null where a check digit disproves it."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    flat = F.regexp_replace(hit, "[^0-9A-Z]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return (
        F.when(hit.contains("@"), "email")
        .when(hit.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_mod97(F.concat(F.substring(flat, 5, 34), F.substring(flat, 1, 4))) == 1, "iban"))
        .when(hit.rlike(f"^{_CARD}$"), F.when(_luhn_digit(body) == F.right(digits, F.lit(1)), "card"))
        .when(hit.rlike(f"^{_IP}$"), "ip")
        .when(hit.rlike(f"^{_SSN}$"), "ssn")
        .when(hit.rlike("[0-9]"), "phone")
        .otherwise("person")
    )


def canonical_of(kind: Column, hit: Column) -> Column:
    """One form for all ways of writing an entity; for a part of a name its lower case."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(hit))
        .when(kind == "iban", F.regexp_replace(hit, r"\x20", ""))
        .when(kind == "ip", hit)
        .when(kind == "phone", F.when(hit.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
        .when(kind.isin("person", *GIVEN_KINDS), F.lower(hit))
        .otherwise(digits)
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _choice(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n % len(words) + 1)


def _name(kind: Column, canonical: Column, digest: Column, attempt: Column) -> Column:
    """A name of three syllables and an ending; each attempt adds a syllable."""
    script = _script(canonical)
    out = None
    for name, parts in SYLLABLES.items():
        drawn = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _choice(parts, _byte(digest, i)))  # noqa: B023
        end = F.lit(NAME_END["person"][name])
        for k in GIVEN_KINDS:
            end = F.when(kind == k, NAME_END[k][name]).otherwise(end)
        made = F.concat(F.array_join(drawn, ""), end)
        out = F.when(script == name, made) if out is None else out.when(script == name, made)
    return out


def draws(key: str, kind: Column, canonical: Column, attempt: Column) -> tuple[Column, Column]:
    """The digests that decide a replacement: of the entity, and of the host of an address."""
    domain = F.substring_index(canonical, "@", -1)
    return _digest(key, kind, canonical, attempt), _digest(key, F.lit("host"), domain, F.lit(0))


def _more(digest: Column, n: Column, letters: bool = False) -> Column:
    """``n`` drawn digits or lower-case letters, from the last bytes of the digest."""

    def one(i: Column) -> Column:
        b = _byte(digest, 30 - i % 31)
        return F.char((b % 26 + 97).cast("long")) if letters else (b % 10).cast("string")

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise(F.lit(""))


def replacement(kind: Column, canonical: Column, attempt: Column, d: Column, host_d: Column) -> Column:
    """The canonical form of the surrogate, from the entity and its :func:`draws`.

    The room grows with the attempt: an address by a letter, a name by a syllable, other numbers
    by a digit after ``SAME_LENGTH`` attempts. Cards and network addresses keep their form, with
    room for at least 10^11 of one length and first digit and for 3.6 * 10^9.
    """
    n = F.length(canonical)
    host = F.regexp_extract(canonical, r"@(.*)\.[^.]*$", 1)
    local = F.concat(_redrawn(F.substring_index(canonical, "@", 1), d), _more(d, attempt, letters=True))
    email = F.concat(local, F.lit("@"), _redrawn(host, host_d), F.lit(".example"))
    longer = _more(d, attempt - SAME_LENGTH + 1)
    card = F.concat(F.substring(canonical, 1, 1), _digits(d, n - 2))
    tail = F.concat(_redrawn(F.substring(canonical, 5, 34), d), longer)
    country = F.substring(canonical, 1, 2)
    octet = lambda i, most: (1 + _byte(d, F.lit(i)) % most).cast("string")
    phone = F.when(canonical.startswith("+"), F.concat(F.substring(canonical, 1, 2), _digits(d, n - 2))).otherwise(_digits(d, n))
    return (
        F.when(kind == "email", email)
        .when(kind == "iban", F.concat(country, _two(98 - _mod97(F.concat(tail, country, F.lit("00")))), tail))
        .when(kind == "card", F.concat(card, _luhn_digit(card)))
        .when(kind == "ip", F.concat_ws(".", octet(0, 223), octet(1, 254), octet(2, 254), octet(3, 254)))
        .when(kind == "ssn", F.concat(F.lit("9"), _digits(d, n - 1), longer))
        .when(kind == "phone", F.concat(phone, longer))
        .otherwise(_name(kind, canonical, d, attempt))
    )


def _dressed(hit: Column, plain: Column) -> Column:
    """The letters and digits of ``plain`` in the places of those of ``hit``, what is left behind them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        taken = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(a["out"], F.when(taken, F.substr(plain, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + F.when(taken, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(_chars(hit), start, step, lambda a: F.concat(a["out"], F.substr(plain, a["at"], F.length(plain))))


def _cased(like: Column, text: Column) -> Column:
    return F.when(like == F.lower(like), F.lower(text)).when(like == F.upper(like), F.upper(text)).otherwise(F.initcap(text))


def _cased_mail(like: Column, text: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(text)).otherwise(text)


def _initial(text: Column, digest: Column) -> Column:
    """A letter of the script of an initial, in its case."""
    return _cased(text, F.substring(_name(F.lit("person"), F.lower(text), digest, F.lit(0)), 1, 1))


def _person(hit: Column, parts: Column, title: str) -> Column:
    """The titled name with the parts ``made`` in the places of its words."""
    head = F.regexp_extract(hit, f"^({title})", 1)
    between = F.split(F.substr(hit, F.length(head) + 1), _NAME_TOKEN, -1)
    return F.concat(head, F.array_join(F.flatten(F.zip_with(between, parts, lambda b, p: F.array(b, F.coalesce(p["made"], F.lit(""))))), ""))


def _placed(hit: Column, kind: Column, plain: Column, parts: Column, title: str) -> Column:
    """The replacement in the form of ``hit``; ``parts`` is set where it is a titled name."""
    flat = F.regexp_replace(plain, "[^0-9A-Za-z]", "")
    return (
        F.when(kind.isNull(), hit)
        .when(parts.isNotNull(), _person(hit, parts, title))
        .when(kind.isin("person", *GIVEN_KINDS), _cased(hit, plain))
        .when(kind == "ip", plain)
        .when(kind == "email", _cased_mail(hit, plain))
        .otherwise(_dressed(hit, flat))
    )


def _with(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def _surrogates(hits: str, mentioned: str, attempts: Column, key: str, names: Names) -> Column:
    """What stands in place of each match: one step of the work per pass over the array, so that
    every value is computed once."""
    seen = F.transform(hits, lambda h: F.struct(h.alias("hit"), F.try_element_at(F.col(mentioned), F.lower(h)).alias("mention")))
    kinds = F.transform(seen, lambda x: _with(x, ("hit", "mention"), kind=F.coalesce(x["mention"], kind_of(x["hit"]))))
    titled = lambda x: x["mention"].isNull() & (x["kind"] == "person")
    named = F.transform(
        kinds,
        lambda x: _with(x, ("hit", "kind"), canonical=canonical_of(x["kind"], x["hit"]), parts=F.when(titled(x), names.parts(x["hit"]))),
    )

    def tried(kind: Column, canonical: Column) -> Column:
        return F.coalesce(F.try_element_at(attempts, F.concat(kind, F.lit("|"), canonical)), F.lit(0))

    def known(x: Column) -> Column:
        parts = F.transform(x["parts"], lambda p: _with(p, ("text", "kind"), attempt=tried(p["kind"], F.lower(p["text"]))))
        return _with(x, ("hit", "kind", "canonical"), parts=parts, attempt=tried(x["kind"], x["canonical"]))

    def draw(x: Column) -> Column:
        d, host_d = draws(key, x["kind"], x["canonical"], x["attempt"])
        digest = lambda p: _digest(key, p["kind"], F.lower(p["text"]), p["attempt"])
        parts = F.transform(x["parts"], lambda p: _with(p, ("text", "kind", "attempt"), d=digest(p)))
        return _with(x, ("hit", "kind", "canonical", "attempt"), parts=parts, d=d, host_d=host_d)

    def made(x: Column) -> Column:
        plain = replacement(x["kind"], x["canonical"], x["attempt"], x["d"], x["host_d"])
        name = lambda p: _cased(p["text"], _name(p["kind"], F.lower(p["text"]), p["d"], p["attempt"]))
        of_part = lambda p: F.when(p["kind"] == "", p["text"]).when(p["kind"] == "initial", _initial(p["text"], p["d"])).otherwise(name(p))
        parts = F.transform(x["parts"], lambda p: F.struct(of_part(p).alias("made")))
        return _with(x, ("hit", "kind"), plain=plain, parts=parts)

    plain = F.transform(F.transform(F.transform(named, known), draw), made)
    return F.transform(plain, lambda x: _placed(x["hit"], x["kind"], x["plain"], x["parts"], names.title))


def _mentions(text: Column, names: Names) -> Column:
    """Lower-case parts of the titled names of a text, with their kind."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({names.person})"), F.lit(1)))
    parts = F.filter(F.flatten(F.transform(found, names.parts)), lambda p: p["kind"].isin("person", *GIVEN_KINDS))
    pair = lambda p: F.struct(F.lower(p["text"]).alias("key"), p["kind"].alias("value"))
    # A word that is a family name and a given name counts as family name.
    both = F.array_distinct(F.transform(F.concat(F.filter(parts, lambda p: p["kind"] == "person"), F.filter(parts, lambda p: p["kind"] != "person")), pair))
    keys = F.transform(both, lambda x: x["key"])
    return F.map_from_entries(F.filter(both, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


_NO_NAMES = "map<string,string>"


def _found(docs: DataFrame, mentioned: str, hits: str, pieces: str, names: Names) -> DataFrame:
    """``docs`` with the names, the matches, and the pieces of text between them.

    Longer names stand first in the pattern of a document, so that a mention is taken whole.
    """
    text = docs["text"]
    titled = F.when(text.rlike(names.title), _mentions(text, names)).otherwise(F.from_json(F.lit("{}"), _NO_NAMES))
    with_names = docs.withColumn(mentioned, titled)
    ordered = F.reverse(F.array_sort(F.map_keys(mentioned)))
    # Before the other kinds come titled names, so that a part of one is not taken for a mention.
    mentions = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?iu:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    pattern = F.when(F.size(F.map_keys(mentioned)) > 0, F.concat(F.lit(names.entity + "|"), mentions)).otherwise(F.lit(names.entity))
    cue = text.rlike(names.cue)
    found = F.when(cue, F.regexp_extract_all(text, pattern, F.lit(0)))
    return with_names.withColumn(hits, found).withColumn(
        pieces, F.when(F.size(hits) > 0, F.split(text, pattern, -1))
    )


def _uses(docs: DataFrame, names: Names, *keep: Column) -> DataFrame:
    """``kind, canonical`` of the entities of each text, after the columns ``keep``.

    Titled names are also found by themselves, as mentions of them are replaced wherever they stand.
    """
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    titled = F.when(docs["text"].rlike(names.title), found(names.person)).otherwise(F.array().cast("array<string>"))
    hits = F.array_union(found(names.entity), titled)
    each = docs.filter(docs["text"].rlike(names.cue)).select(*keep, F.explode(hits).alias("hit"))
    each = each.select(*each.columns, kind_of(F.col("hit")).alias("kind")).filter(F.col("kind").isNotNull())
    whole = F.array(F.struct(F.col("kind"), canonical_of(F.col("kind"), F.col("hit")).alias("canonical")))
    parts = F.filter(names.parts(F.col("hit")), lambda p: p["kind"].isin("person", *GIVEN_KINDS))
    parts = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), F.lower(p["text"]).alias("canonical")))
    each = each.withColumn("e", F.explode(F.when(F.col("kind") == "person", parts).otherwise(whole)))
    return each.select(*(c for c in each.columns if c not in ("hit", "kind", "e")), "e.kind", "e.canonical")


def entities(docs: DataFrame, names: Names = NAMES) -> DataFrame:
    """Distinct ``kind, canonical`` of the whole corpus (each part of a name by itself)."""
    return _uses(docs, names).distinct()


def clashes(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame | None:
    """``kind, canonical, attempt`` of the entities that must not take their first draw; None if
    there are none. Of entities with one replacement the smallest keeps it, the others draw again
    until no clash is left."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")

    def draw(state: DataFrame) -> DataFrame:
        d, host_d = draws(key, kind, canonical, attempt)
        drawn = state.withColumns({"d": d, "host_d": host_d})
        plain = replacement(kind, canonical, attempt, F.col("d"), F.col("host_d"))
        return drawn.select("kind", "canonical", "attempt", plain.alias("plain"))

    # A name that occurs as family or given name is none to draw for either.
    real = found.select(kind.alias("real_kind"), canonical.alias("plain")).withColumn("real", F.lit(True))
    names = F.array(F.lit("person"), *map(F.lit, GIVEN_KINDS))
    as_kinds = F.when(F.col("real_kind").isin("person", *GIVEN_KINDS), names).otherwise(F.array("real_kind"))
    real = real.select(F.explode(as_kinds).alias("kind"), "plain", "real").distinct()
    drawn = store(draw(found.withColumn("attempt", F.lit(0))))
    turn = 0
    while True:
        shared = drawn.groupBy("kind", "plain").agg(
            F.min(F.struct("attempt", "canonical"))["canonical"].alias("keeper"), F.count(F.lit(1)).alias("k")
        )
        bad = shared.join(real, ["kind", "plain"], "left").filter((F.col("k") > 1) | F.col("real"))
        losers = drawn.join(bad, ["kind", "plain"]).filter(F.coalesce("real", F.lit(False)) | (canonical != F.col("keeper")))
        losers = store(losers.select("kind", "canonical", (attempt + 1).alias("attempt")))
        if losers.limit(1).count() == 0:
            return None if turn == 0 else drawn.filter("attempt > 0").drop("plain")
        held = drawn.join(losers.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        drawn = store(held.unionByName(draw(losers)))
        turn += 1


def with_surrogates(docs: DataFrame, key: str = DEFAULT_KEY, count_as: str | None = None, names: Names = NAMES) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and their number as ``count_as`` if named.

    Null and empty texts stay, repeated rows and long texts are rows like others. Other columns are
    not touched. The draw depends on ``key`` and the entity, and on the corpus only where
    replacements clash. The pattern of a document grows with the different names in it.
    """
    again = clashes(store(entities(docs, names)), key)
    mentioned, hits, pieces = (fresh(docs, c) for c in ("pii_names", "pii_hits", "pii_pieces"))
    split = _found(docs, mentioned, hits, pieces, names)
    none = F.from_json(F.lit("{}"), "map<string,int>")
    attempts = none
    if again is not None:
        mark, held = fresh(docs, "pii_key"), fresh(docs, "pii_attempts")
        split = split.withColumn(mark, F.md5("text"))
        uses = _uses(docs, names, F.md5("text").alias(mark))
        uses = uses.join(small(again), ["kind", "canonical"]).select(mark, F.concat_ws("|", "kind", "canonical").alias("e"), "attempt").distinct()
        uses = store(uses.groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias(held)))
        split = split.join(small(uses), mark, "left")
        attempts = F.coalesce(held, none)
    new = _surrogates(hits, mentioned, attempts, key, names)
    before = F.slice(F.col(pieces), F.lit(1), F.size(hits))
    pairs = F.flatten(F.zip_with(before, new, lambda p, r: F.array(p, r)))
    glued = F.concat(F.array_join(pairs, ""), F.element_at(pieces, -1))
    text = F.when(F.size(hits) > 0, glued).otherwise(docs["text"])
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if count_as:
        proved = F.filter(hits, lambda h: F.map_contains_key(F.col(mentioned), F.lower(h)) | kind_of(h).isNotNull())
        out.append(F.when(F.size(hits) > 0, F.size(proved)).otherwise(F.lit(0)).cast("long").alias(count_as))
    return split.select(*out)
