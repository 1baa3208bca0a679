"""Surrogates for personal data: keyed replacements that keep type, gender, script and format."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, read, text_of

#: Titles that tell a person's gender, and those that don't.
MALE = ("Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mademoiselle", "Mme", "Mlle", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "д-р", "Δρ")
#: Given names that introduce a person without a title.
MEN = (
    "Ahmed", "Alejandro", "Alexander", "Andreas", "Andrew", "Antonio", "Carlos", "Charles", "Christopher", "Daniel", "David", "Diego", "Dmitri", "Edward", "Fernando", "François", "Friedrich", "George", "Giorgos",
    "Hans", "Heinrich", "Henri", "Ivan", "Jacques", "James", "Javier", "Jean", "John", "José", "Juan", "Jürgen", "Karl", "Klaus", "Luis", "Manuel", "Matthew", "Michael", "Miguel", "Mohammed", "Nicolas", "Olivier", "Pablo",
    "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Robert", "Sergei", "Stefan", "Thomas", "William", "Wolfgang", "Иван", "Дмитрий", "Сергей", "Алексей", "Γιώργος", "Νίκος", "Κώστας",
)
WOMEN = (
    "Alice", "Amélie", "Ana", "Anastasia", "Andrea", "Anna", "Anne", "Barbara", "Camille", "Carmen", "Catherine", "Céline", "Charlotte", "Chloé", "Claudia", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Françoise",
    "Gabriela", "Heidi", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lucía", "María", "Marie", "Martha", "Mary", "Monika", "Natalia", "Olga", "Patricia", "Petra",
    "Rosa", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Svetlana", "Ursula", "Анна", "Елена", "Мария", "Ольга", "Ελένη", "Μαρία", "Σοφία",
)
_TITLE = "(?:(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?|M\.)"
_GIVEN = "(?:" + "|".join(MEN + WOMEN) + ")"

#: Kinds by order of trial, as Java patterns.  Each begins at the begin of a token.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z+.-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z-])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE} \p{{Lu}}\p{{L}}{{1,40}}(?: \p{{Lu}}\p{{L}}{{1,40}})?|{_GIVEN} \p{{Lu}}\p{{L}}{{1,40}})(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
#: From this attempt on a number gains a digit an attempt, and an address leaves its private network: its format is crowded.
CROWDED = 6
#: A text without any of these has no entity.
HINT = r"@|[0-9]{2}|[0-9][.-]|(?:^|[^\p{L}])(?:" + _TITLE + "|" + _GIVEN + r") \p{Lu}"

#: By script: what begins a syllable, what ends it, and the endings of first names by gender.
SYLLABLES = {
    "latin": ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "st"),
    "cyrillic": ("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ч", "ст"),
    "greek": ("β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "κρ", "στ"),
}
VOWELS = {"latin": ("a", "e", "i", "o"), "cyrillic": ("а", "е", "и", "о"), "greek": ("α", "ε", "ι", "ο")}
ENDINGS = {
    "latin": {"f": ("a", "ia", "ina", "elle"), "m": ("o", "an", "er", "us"), "n": ("ey", "en", "is", "el")},
    "cyrillic": {"f": ("а", "ия", "ина", "ья"), "m": ("", "ий", "ан", "ей"), "n": ("о", "и", "е", "у")},
    "greek": {"f": ("α", "η", "ία", "ώ"), "m": ("ος", "ης", "ας", "ων"), "n": ("ι", "ο", "ου", "ε")},
}


def _byte(digest: Column, i) -> Column:
    """The i-th byte of a hex digest, from 0, coming round at its end."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)) if not isinstance(i, int) else F.substring(digest, i % 32 * 2 + 1, 2), 16, 10).cast("int")


def _pick(values: Column, n: Column) -> Column:
    return F.element_at(values, n % F.size(values) + 1)


def _masked(text: Column, digest: Column) -> Column:
    """Letters for letters, digits for digits, the rest as it stands."""

    def one(i: Column) -> Column:
        c, b = F.substring(text, i + 1, F.lit(1)), _byte(digest, i)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1))
        return F.when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[0-9]"), (b % 10).cast("string")).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits by the card rule; a multiple of 10 is valid."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)))


def _mod97(code: Column) -> Column:
    """A code's number modulo 97, letters counting from 10; an IBAN's is taken with its first four signs at the end."""
    place = F.sequence(F.lit(1), F.length(code))
    return F.aggregate(place, F.lit(0), lambda a, i: let(F.substring(code, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)))


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: digits of a number, small letters of an address, the name without its title."""
    name = F.regexp_replace(mention, f"^{_TITLE} ", "")
    title = F.regexp_replace(F.regexp_extract(mention, f"^({_TITLE}) ", 1), r"\.$", "")
    given = F.when(F.size(F.split(name, " ")) > 1, F.substring_index(name, " ", 1)).otherwise("")
    woman = title.isin(*FEMALE) | (~title.isin("M", *MALE) & given.isin(*WOMEN))
    man = title.isin("M", *MALE) | given.isin(*MEN)
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "person", F.concat(F.when(woman, "f").when(man, "m").otherwise("n"), F.lit(" "), F.lower(name)))
        .when(kind == "ip", mention)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity (in canonical form) at a given attempt, from a keyed digest."""
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, attempt.cast("string"), entity), 256)
    more = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("more"), attempt.cast("string"), kind, entity), 256)

    def email(d: Column) -> Column:
        local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
        own = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), domain), 256)
        host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
        longer = F.when(attempt >= 3, F.concat(F.lit("."), F.substring(more, 1, 10))).otherwise("")
        return F.concat(_masked(local, d), longer, F.lit("@"), _masked(host, own), F.lit("."), F.substring_index(domain, ".", -1))

    def ip(d: Column) -> Column:
        o = F.split(entity, r"\.")
        kept = F.when(o[0] == "10", 1).when((o[0] == "192") & (o[1] == "168"), 2).when((o[0] == "127"), 1).otherwise(0)
        kept = F.when(attempt >= CROWDED, 0).otherwise(kept)
        part = lambda i: F.when(kept > i, o[i]).otherwise(((_byte(d, 2 * i) % 222 + 1) if i == 0 else _byte(d, 2 * i)).cast("string"))
        return F.concat_ws(".", *map(part, range(4)))

    def digits(d: Column, keep: Column) -> Column:
        """As many digits, the first ``keep`` as they are; a leading digit isn't made 0."""
        one = lambda i: F.when(i < keep, F.substring(entity, i + 1, F.lit(1))).otherwise(((_byte(d, i) * 256 + _byte(d, i + 11)) % 10).cast("string"))
        longer = F.when(attempt >= CROWDED, F.array_join(F.transform(F.sequence(F.lit(CROWDED), attempt), lambda i: (_byte(more, i) % 10).cast("string")), "")).otherwise("")
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.length(entity) - 1), one), ""), F.when(kind == "card", "").otherwise(longer))

    def card(d: Column) -> Column:
        body = digits(d, F.lit(1))
        cut = F.substring(body, F.lit(1), F.length(body) - 1)
        return F.when(_luhn(entity) % 10 == 0, let(cut, lambda c: F.concat(c, ((10 - _luhn(F.concat(c, F.lit("0"))) % 10) % 10).cast("string")))).otherwise(body)

    def person(d: Column) -> Column:
        """A first and a last name, or a last name alone, in the script and of the gender of the entity."""
        script = lambda by: F.when(entity.rlike(r"\p{IsCyrillic}"), by("cyrillic")).when(entity.rlike(r"\p{IsGreek}"), by("greek")).otherwise(by("latin"))
        values = lambda v: F.array(*map(F.lit, v))
        gender = lambda s: F.when(F.substring(entity, 1, 1) == "f", values(ENDINGS[s]["f"])).when(F.substring(entity, 1, 1) == "m", values(ENDINGS[s]["m"])).otherwise(values(ENDINGS[s]["n"]))
        sounds = F.struct(script(lambda s: values(SYLLABLES[s])).alias("begin"), script(lambda s: values(VOWELS[s])).alias("vowel"), script(gender).alias("end"))

        def named(x: Column) -> Column:
            syllables = lambda i, n: F.concat(*[F.concat(_pick(x["begin"], _byte(d, i + 2 * k)), _pick(x["vowel"], _byte(d, i + 2 * k + 1))) for k in range(n)])
            first = F.initcap(F.concat(syllables(0, 2), _pick(x["begin"], _byte(d, 4)), _pick(x["end"], _byte(d, 5))))
            last = F.initcap(F.concat(syllables(8, 3), F.when(attempt >= 3, syllables(16, 3)).otherwise("")))
            return F.when(F.size(F.split(entity, " ")) > 2, F.concat(first, F.lit(" "), last)).otherwise(last)

        return let(sounds, named)

    def iban(d: Column) -> Column:
        """As long, in the same country; with a right check if the entity has one."""
        land, body = F.substring(entity, 1, 2), _masked(F.substring(entity, F.lit(5), F.length(entity)), d)
        right = _mod97(F.concat(F.substring(entity, F.lit(5), F.length(entity)), F.substring(entity, 1, 4))) == 1
        checked = let(body, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(right, checked).otherwise(F.concat(land, _masked(F.substring(entity, 3, 2), more), body))

    country = F.when(F.length(entity) > 10, F.length(entity) - 10).otherwise(0)
    return (
        F.when(kind == "email", email(digest))
        .when(kind == "ip", ip(digest))
        .when(kind == "card", card(digest))
        .when(kind == "iban", iban(digest))
        .when(kind == "person", person(digest))
        .when(kind == "phone", digits(digest, country))
        .otherwise(digits(digest, F.lit(0)))
    )


def formatted(kind: Column, mention: Column, made: Column) -> Column:
    """The replacement in the format of one mention: its separators, title and capitals; digits beyond the mention's come last."""
    surplus = F.substring(made, F.length(F.regexp_replace(mention, "[^0-9]", "")) + 1, F.length(made))
    shape = lambda keep: F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: let(F.substring(mention, i, F.lit(1)), lambda c: F.when(c.rlike(keep), F.substring(made, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), f"[^{keep[1:]}", "")), F.lit(1))).otherwise(c))), "")
    title = F.regexp_extract(mention, f"^({_TITLE} )", 1)
    name = F.regexp_replace(mention, f"^{_TITLE} ", "")
    return (
        F.when(kind == "email", F.when((mention == F.upper(mention)), F.upper(made)).otherwise(made))
        .when(kind == "ip", made)
        .when(kind == "person", F.concat(title, F.when(name == F.upper(name), F.upper(made)).otherwise(made)))
        .when(kind == "iban", shape("[A-Z0-9]"))
        .otherwise(F.concat(shape("[0-9]"), surplus))
    )


def kind_of(mention: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed([x for x in PATTERNS.items() if x[0] != "person"]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, made: a surrogate for each of the distinct ``entities`` (kind, entity).

    No two entities of a kind share one and none is an entity of the corpus.  Those whose draw
    fails the check draw again by the next attempt, until all pass; the least entity of those
    that share a draw keeps it.  From attempt CROWDED on draws come from more values than the format
    has, so a corpus that holds all values of a format ends too.
    """
    done, left = None, durable(entities.select("kind", "entity", F.lit(0).alias("attempt")), "surrogates-left")
    entities = left.select("kind", "entity")
    while True:
        drawn = durable(left.select("kind", "entity", "attempt", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key).alias("made")), "surrogates-drawn")
        real = entities.select(F.col("kind"), F.regexp_replace("entity", "^[fmn] ", "").alias("made"), F.lit(True).alias("real")).distinct()
        keeps = drawn.groupBy("kind", "made").agg(F.min("entity").alias("entity"))
        passed = keeps.join(real, [keeps["kind"] == real["kind"], F.lower(keeps["made"]) == real["made"]], "left_anti")
        if done is not None:
            passed = passed.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        passed = durable(passed.select("kind", "entity", "made"), "surrogates")
        rest = durable(drawn.join(passed, ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "surrogates-left")
        done = passed if done is None else done.unionByName(passed)
        left = rest
        if not rest.head(1):
            return done


def with_full_names(each: DataFrame) -> DataFrame:
    """``each`` mention (row, at, kind, entity, made), where a titled surname takes that of the full name of its row with the same gender and surname, if any; if either gender is unknown, with the same surname."""
    gender, surname = F.substring("entity", 1, 1), F.substring_index("entity", " ", -1)
    person, two = F.col("kind") == "person", F.size(F.split("entity", " ")) > 2
    named = each.where(person & two).select("row", "at", gender.alias("gender"), surname.alias("surname"), F.substring_index("made", " ", -1).alias("part"))
    full = named.groupBy("row", "gender", "surname").agg(F.min_by("part", "at").alias("part"))
    loose = named.groupBy("row", "surname").agg(F.min_by(F.struct("part", "gender"), "at").alias("any"))
    single = each.select("*", F.when(person & ~two, gender).alias("gender"), F.when(person & ~two, surname).alias("surname"))
    met = single.join(full, ["row", "gender", "surname"], "left").join(loose, ["row", "surname"], "left")
    unsure = (F.col("gender") == "n") | (F.col("any.gender") == "n")
    return met.withColumn("made", F.coalesce("part", F.when(unsure, F.col("any.part")), "made")).drop("gender", "surname", "part", "any")


def bare_names(each: DataFrame) -> DataFrame:
    """row, names: what replaces each row's names and surnames where they stand without a title, the longest first; the first mention decides."""
    name = F.regexp_replace("mention", f"^{_TITLE} ", "")
    cased = lambda n, made: F.struct(n.alias("name"), F.when(n == F.upper(n), F.upper(made)).otherwise(made).alias("value"))
    last = lambda c: F.substring_index(c, " ", -1)
    pairs = each.where("kind = 'person'").select("row", "at", F.explode(F.array(cased(name, F.col("made")), cased(last(name), last(F.col("made"))))).alias("p")).select("row", "at", "p.*")
    first = pairs.groupBy("row", "name").agg(F.min_by("value", F.struct("at", "value")).alias("value"))
    return first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.length("name")).alias("shorter"), "name", "value"))).alias("names"))


def replace_personal_data(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_entities of each row: its text with each detected entity replaced by its surrogate.

    One entity has one surrogate throughout, in the format of each mention; who lacks ``key`` can't redo the draw.  A person is detected by a
    title or by a given name of MEN or WOMEN before a surname; in the same text, the name and the surname without the title, and the title with the
    surname alone, are replaced by the same surrogate or its surname.  Names that neither introduces
    in their text, and first names alone, stay.

    Nulls: a null text stays null, with 0 entities; a null id is an id like others.  Empty
    texts and texts without entities stay as they are.  Repeated rows come out alike, and rows
    that share an id have their own texts.  An empty table gives no rows.  Other columns
    aren't read.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("text_hash"))
    hinted = keyed.where(F.col("text").rlike(HINT)).select("doc_id", "text_hash", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions")).where("size(mentions) > 0")
    found = durable(hinted, "mentions")
    mention = durable(found.select(F.explode("mentions").alias("mention")).distinct().select("mention", kind_of(F.col("mention")).alias("kind")).select("*", canonical(F.col("kind"), F.col("mention")).alias("entity")), "mentions-kinds")
    made = surrogate_table(mention.select("kind", "entity").distinct(), key)
    by = mention.join(made, ["kind", "entity"])
    row = F.struct("doc_id", "text_hash").alias("row")
    each = durable(found.dropDuplicates(["doc_id", "text_hash"]).select(row, F.posexplode("mentions").alias("at", "mention")).join(by, "mention"), "mentions-made")
    each = with_full_names(each)
    lists = each.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", formatted(F.col("kind"), F.col("mention"), F.col("made")).alias("instead")))), lambda x: x["instead"]).alias("instead"))
    joined = keyed.select(row, "text").join(lists.join(bare_names(each), "row", "left").hint("merge"), "row", "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform("names", lambda n: n["name"]), "|"), F.lit(r")(?!\p{L})"))
    hits = lambda x: F.regexp_extract_all(x, pattern, F.lit(0))
    value = lambda m: F.filter("names", lambda n: n["name"] == m)[0]["value"]
    renamed = lambda x: F.when(F.col("names").isNull(), x).otherwise(let(hits(x), lambda h: F.array_join(F.transform(F.split(x, pattern), lambda y, k: F.concat(F.when(k > 0, value(F.get(h, k - 1))).otherwise(""), y)), "")))
    filled = let(F.split("text", ANY), lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(F.when(i > 0, F.get(F.col("instead"), i - 1)).otherwise(""), renamed(x))), ""))
    n_bare = F.when(F.col("names").isNull(), 0).otherwise(F.aggregate(F.split("text", ANY), F.lit(0), lambda n, x: n + F.size(hits(x))))
    return joined.select(F.col("row.doc_id").alias("doc_id"), F.when(F.col("instead").isNull(), F.col("text")).otherwise(filled).alias("text"), F.when(F.col("instead").isNull(), 0).otherwise(F.size("instead") + n_bare).cast("long").alias("n_entities"))


#: The key where ``lodestone.surrogates.key`` names none: drawn anew for each process.
_DRAWN = token_hex(16)


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_personal_data(read(spark, sf_dir, "documents"), key=spark.conf.get("lodestone.surrogates.key", _DRAWN))
