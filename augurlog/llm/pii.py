"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, card and account numbers, social security
numbers, IP addresses, passwords and tokens, names after a title) are taken apart into *units*: a
kept lead such as ``password=`` or ``Mrs. ``, and the value.  A unit is replaced by a surrogate of
the same type, format, script and, for given names, gender, derived from a keyed hash of its
normal form, so mentions of one thing get one surrogate in every document, whatever their
separators or case.

Distinctness is checked: all distinct units meet in one table; a surrogate that equals a value
found in the corpus, or that two units share, is drawn again, until none is left.  That table holds
one short row per distinct value; documents without entities are never shuffled, and a value that
stands in a third of all documents is one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurlog.llm.textcore import unused
from augurlog.session import materialise

# Words that introduce a secret, titles by gender, and given names.
SECRET_WORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_key"]
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carlo", "David", "Erik", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Niklas", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("n", "latin"): ["Alex", "Robin", "Sascha", "Kim", "Noa", "Charlie", "Jules", "Dominique", "Andrea", "Jamie", "Toni", "Sam", "Micha", "Luca", "Eli", "Nikita"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Надежда", "Ольга", "Полина", "Раиса", "Софья"],
    ("m", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Λεωνίδας", "Μάνος", "Νίκος", "Παύλος", "Πέτρος", "Σταύρος", "Σωτήρης", "Τάσος", "Φώτης"],
    ("f", "greek"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ειρήνη", "Ελένη", "Ζωή", "Θεοδώρα", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Ουρανία", "Σοφία", "Χαρά"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "dal", "den", "fal", "gar", "hol", "kan", "lin", "mar", "mel", "nor", "ros", "sen", "tor", "vin"],
    "cyrillic": ["ба", "вер", "дал", "гор", "зар", "кан", "лин", "мар", "мел", "нор", "рос", "сен", "тар", "вин", "жан", "пол"],
    "greek": ["βα", "γερ", "δαλ", "ζαρ", "καν", "λιν", "μαρ", "μελ", "νορ", "παν", "ρος", "σεν", "ταρ", "φιν", "χαν", "πολ"],
}
ENDINGS = {"latin": "er", "cyrillic": "ко", "greek": "ος"}

_ALL_TITLES = "|".join(t for group in TITLES.values() for t in group)
_LOCAL = "A-Za-z0-9._%+-"
_HEX = "[0-9A-Fa-f]{1,4}"
_SECRET = rf"(?i:{'|'.join(SECRET_WORDS)})\"?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?"
PATTERN = "|".join([
    rf"(?<![A-Za-z0-9]){_SECRET}[^\s\"'<>,;]{{6,}}",
    # Possessive, so the labels of a domain are matched in a loop: a domain of any length needs no stack.
    rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    # Other numbers with a country code: 7 to 15 digits in any groups.
    r"(?<![\p{L}\d+])\+\d(?:[ .()/-]{0,2}\d){6,14}(?!\d)",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)",
    # National numbers: a leading 0 and groups, 3-3-4 with spaces, and nine digits that begin with 6 to 9.
    r"(?<![\p{L}\d.,+-])(?!\d\d[/-]\d\d[/-]\d{4})0(?=(?:\d[ /-]?){8,11}(?!\d))\d{1,4}[ /-]\d{2,8}(?:[ /-]\d{2,8}){0,4}(?!\d)",
    r"(?<![\p{L}\d.,+-])\d{3} \d{3} \d{4}(?![\d-])",
    r"(?<![\p{L}\d.,+-])[6-9]\d{2}(?:(?: \d{3}){2}|(?: \d{2}){3})(?![\d-])",
    rf"(?<![\p{{L}}\d:.])(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{7}}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\d:])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_ALL_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
])

ALIKE_ATTEMPTS = 16


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(v: str) -> str:
    """SQL for the type of a detected string."""
    secret, title = _quoted("^" + _SECRET), _quoted(rf"^(?:{_ALL_TITLES})\.? ")
    return f"""CASE
      WHEN {v} rlike {secret} THEN 'secret' WHEN contains({v}, '@') THEN 'email' WHEN {v} rlike '^AKIA' THEN 'key'
      WHEN {v} rlike '^[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]+$' THEN 'ip6'
      WHEN {v} rlike '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban' WHEN {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
      WHEN {v} rlike {_quoted(r'^[0-9]{1,3}([.][0-9]{1,3}){3}$')} THEN 'ip' WHEN {v} rlike {title} THEN 'name'
      WHEN {v} rlike {_quoted(r'^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$')} THEN 'phone'
      WHEN length(regexp_replace({v}, '[^0-9]', '')) < 13 THEN 'phone' ELSE 'card' END"""


def _units(v: str) -> str:
    """SQL for the units (lead, kind, value) of a detected string."""
    lead = f"regexp_extract({v}, {_quoted('^' + _SECRET)}, 0)"
    title = f"regexp_extract({v}, {_quoted(rf'^(?:{_ALL_TITLES})[.]? ')}, 0)"
    name = f"substr({v}, length({title}) + 1)"
    group = "|".join(TITLES["m"]), "|".join(TITLES["f"])
    gender = f"CASE WHEN {v} rlike '^(?:{group[1]})[.]? ' THEN 'f' WHEN {v} rlike '^(?:{group[0]})[.]? ' THEN 'm' ELSE 'n' END"
    one = lambda lead, kind, value: f"named_struct('lead', {lead}, 'kind', {kind}, 'value', {value})"
    return f"""CASE {_kind(v)}
      WHEN 'secret' THEN array({one(lead, "'secret'", f"substr({v}, length({lead}) + 1)")})
      WHEN 'name' THEN IF(contains({name}, ' '),
        array({one(title, f"concat('given_', {gender})", f"split_part({name}, ' ', 1)")}, {one("' '", "'surname'", f"split_part({name}, ' ', 2)")}),
        array({one(title, "'surname'", name)}))
      ELSE array({one("''", _kind(v), v)}) END"""


def _normal(kind: Column, value: Column) -> Column:
    """What makes two mentions the same thing."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        # Without the country code, or the 0 in its place.
        F.when((kind == "phone") & value.rlike("^[+][0-9]{1,3}[ .()/-]|^0"), F.right(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "^[+][0-9]{1,3}", ""), "[^0-9]", ""), "^0", ""), F.lit(12)))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when((kind == "email") | (kind == "ip6") | (kind == "surname") | kind.startswith("given"), F.lower(value))
        .otherwise(value)
    )


def _surrogate(key: str) -> tuple[str, str, Column]:
    """SQL of the hash and of the drawn characters, and the surrogate: draw number ``attempt`` for a unit (kind, normal form ``norm``)."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    hashed = f"sha2(concat_ws('|', '{secret}', kind, norm, CAST(attempt AS STRING)), 512)"
    pick = lambda letters: f"substr('{letters}', b[i % 64] % {len(letters)} + 1, 1)"
    kept = "CASE kind WHEN 'key' THEN 4 WHEN 'iban' THEN 2 WHEN 'card' THEN 1 ELSE 0 END"
    tail = "CASE kind WHEN 'email' THEN length(norm) - length(substring_index(norm, '.', -1)) ELSE length(norm) END"
    by_class = f"""array_join(transform(split(norm, ''), (c, i) -> CASE
      WHEN i < {kept} OR i >= {tail} THEN c
      WHEN kind = 'phone' AND i = 0 THEN {pick('23456789')}
      WHEN hexed AND c rlike '^[0-9a-f]$' THEN {pick('0123456789abcdef')}
      WHEN c rlike '^[0-9]$' THEN {pick('0123456789')}
      WHEN c rlike '^[A-Z]$' THEN {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}
      WHEN c rlike '^\\\\p{{L}}$' THEN {pick('abcdefghijklmnopqrstuvwxyz')}
      ELSE c END), '')"""
    # The last digit of a card number is its check digit.
    body = "split(substr(drawn, 1, length(drawn) - 1), '')"
    digit = "CAST(c AS INT)"
    doubled = f"(2 * {digit}) % 10 + IF({digit} > 4, 1, 0)"
    weights = f"transform({body}, (c, i) -> CASE WHEN c = '' THEN 0 WHEN (length(drawn) - i) % 2 = 0 THEN {doubled} ELSE {digit} END)"
    luhn = f"concat(substr(drawn, 1, length(drawn) - 1), CAST((10 - aggregate({weights}, 0, (a, x) -> a + x) % 10) % 10 AS STRING))"
    ip = "array_join(transform(split(norm, '[.]'), (c, i) -> CAST(b[i] % 254 + 1 AS STRING)), '.')"
    words = lambda table: "array(" + ", ".join(f"'{w}'" for w in table) + ")"
    syllables = "map(" + ", ".join(f"'{s}', {words(SYLLABLES[s])}" for s in SYLLABLES) + ")"
    endings = "map(" + ", ".join(f"'{s}', '{e}'" for s, e in ENDINGS.items()) + ")"
    given = "map(" + ", ".join(f"'given_{g}{s}', {words([n.lower() for n in names])}" for (g, s), names in GIVEN.items()) + ")"
    made = f"concat(array_join(transform(slice(b, 9, 4), x -> element_at({syllables}, script)[x % 16]), ''), element_at({endings}, script))"
    # A given name is drawn from its list; a second draw lengthens it, so the lists don't run out.
    first = f"coalesce(concat(try_element_at({given}, concat(kind, script))[b[0] % 16], IF(attempt = 0, '', concat('-', {made}))), {made})"
    shape = F.expr(f"CASE WHEN kind = 'ip' THEN {ip} WHEN kind = 'surname' THEN {made} WHEN kind LIKE 'given%' THEN {first} WHEN kind = 'card' THEN {luhn} ELSE drawn END")
    # A form with too few values for its distinct units is made longer in the end.
    longer = F.when(F.col("attempt") >= ALIKE_ATTEMPTS, F.concat(shape, F.substring("hash", 65, 16))).otherwise(shape)
    return hashed, by_class, longer


def _drawn(units: DataFrame, key: str) -> DataFrame:
    hashed, by_class, shape = _surrogate(key)
    script = F.when(F.col("norm").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("norm").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    byte = "transform(sequence(0, 63), i -> CAST(conv(substr(hash, 2 * i + 1, 2), 16, 10) AS INT))"
    hashes = units.withColumn("hash", F.expr(hashed)).withColumn("script", script).withColumn("hexed", F.expr("kind = 'ip6' OR kind = 'secret' AND norm rlike '^[0-9a-f]+$'"))
    # Written out at each step, so that expressions used many times below are computed once.
    hashes = materialise(hashes, "pii_hashes").withColumn("b", F.expr(byte))
    shaped = materialise(materialise(hashes, "pii_bytes").withColumn("drawn", F.expr(by_class)), "pii_drawn")
    return shaped.withColumn("sur", shape).select("kind", "norm", "attempt", "sur")


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, norm, sur) for distinct (kind, norm): no surrogate is a value of the corpus, none is shared.

    Every round keeps the draws that are free and repeats the others; the smallest value wins a
    shared one.  Rounds are written tables; each is a few joins on the narrow table.
    """
    values = materialise(units.select("kind", "norm").distinct(), "pii_values")
    taken = values.select("kind", F.col("norm").alias("sur"))
    pending, done = values.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = _drawn(pending, key)
        first = drawn.groupBy("kind", "sur").agg(F.min("norm").alias("winner"))
        blocked = taken if done is None else taken.union(done.select("kind", "sur"))
        free = first.join(blocked, ["kind", "sur"], "left_anti").withColumn("free", F.lit(True))
        tried = materialise(drawn.join(free, ["kind", "sur"], "left").withColumn("ok", F.coalesce(F.col("free") & (F.col("winner") == F.col("norm")), F.lit(False))), "pii_draws")
        won = tried.where("ok").select("kind", "norm", "sur")
        done = won if done is None else done.union(won)
        pending = tried.where("not ok").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done


def _formatted() -> Column:
    """The surrogate in the format of the mention: its separators, country code and capitals."""
    # Counted from the right, so that a country code in front stays.
    spread = F.expr("""array_join(transform(sequence(1, length(value)), i -> CASE
      WHEN NOT substr(value, i, 1) rlike '^[0-9A-Za-z]$' THEN substr(value, i, 1)
      WHEN length(regexp_replace(substr(value, i), '[^0-9A-Za-z]', '')) > length(sur) THEN substr(value, i, 1)
      ELSE substr(sur, length(sur) - length(regexp_replace(substr(value, i), '[^0-9A-Za-z]', '')) + 1, 1) END), '')""")
    cased = F.expr("""array_join(transform(sequence(1, length(sur)), i -> IF(length(value) = length(sur) AND substr(value, i, 1) rlike '^[A-Z]$',
      upper(substr(sur, i, 1)), substr(sur, i, 1))), '')""")
    separated = F.col("kind").isin("phone", "card", "ssn", "iban")
    bare = F.regexp_replace("value", "[^0-9A-Za-z]", "")
    return (
        F.when(separated & (F.length(bare) >= F.length("sur")), spread)
        .when((F.col("kind") == "surname") | F.col("kind").startswith("given"), F.initcap("sur"))
        .when(F.col("kind") == "email", cased)
        .otherwise(F.col("sur"))
    )


def _likely(text: Column) -> Column:
    """A cheap test that every text with an entity passes: a sign that one needs, or a title."""
    likely = text.rlike("[0-9@=:]")
    for title in (t for group in TITLES.values() for t in group):
        likely = likely | F.contains(text, F.lit(title))
    return likely


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in its text column, and the number of replaced units in ``count``.

    Texts without entities, null and empty ones are returned as they are, with a count of 0.
    Repeated rows are treated alike; other columns pass unchanged.  An empty table stays empty.
    """
    columns = docs.columns
    row, pieces, found = (unused(n, columns) for n in ("row", "pieces", "found"))
    has = F.coalesce(_likely(F.col(f"`{text}`")) & F.col(f"`{text}`").rlike(PATTERN), F.lit(False))
    clean = docs.where(~has).withColumn(count, F.lit(0).cast("long"))
    hits = docs.where(has).withColumn(row, F.monotonically_increasing_id())
    hits = hits.withColumn(pieces, F.split(f"`{text}`", PATTERN, -1)).withColumn(found, F.regexp_extract_all(f"`{text}`", F.lit(PATTERN), F.lit(0)))
    hits = materialise(hits.drop(text), "pii_hits")
    each = hits.select(F.col(row).alias("row"), F.posexplode(found).alias("pos", "mention"))
    units = each.select("row", "pos", F.posexplode(F.expr(_units("mention"))).alias("part", "unit")).select("row", "pos", "part", "unit.*")
    units = materialise(units.withColumn("norm", _normal(F.col("kind"), F.col("value"))), "pii_units")
    chosen = surrogates(units, key)
    new = units.join(chosen, ["kind", "norm"]).select("row", "pos", "part", F.concat("lead", _formatted()).alias("new"))
    mention = new.groupBy("row", "pos").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(part, new))), x -> x.new)"), "").alias("new"), F.count("*").alias("n"))
    whole = mention.groupBy("row").agg(F.expr("transform(array_sort(collect_list(struct(pos, new))), x -> x.new)").alias("news"), F.sum("n").alias("n"))
    whole = whole.select(F.col("row").alias(row), F.col("news").alias(found + "_new"), F.col("n").alias(count))
    built = F.array_join(F.zip_with(F.col(pieces), F.array_append(F.col(found + "_new"), F.lit("")), lambda a, b: F.concat(a, b)), "")
    replaced = hits.join(whole, row).withColumn(text, built)
    return clean.select(*[f"`{c}`" for c in columns], count).union(replaced.select(*[f"`{c}`" for c in columns], count))
