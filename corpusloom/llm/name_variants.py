"""Variant spellings of names typed by people, linked by merging and matching again.

Every distinct spelling is read as family name, given name and initials; an organisation as its own name with the
initials of the words that say what it is. Spellings read alike form profiles. Profiles meet in blocks: equal names;
names that become equal by leaving out one letter (which covers one letter wrong, lost, added or swapped); and initials
or shortened given names with the fuller names they can stand for. Merged profiles unite their spellings and initials,
and enter blocking again until nothing merges. Within a block nothing is paired off: full names meet the
heaviest profile of a part in which all names are close, and a shortened name is linked only if the block holds exactly one author it can stand for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.runtime import discard, intermediates, materialize, salted_join

# Everyday English short forms of given names, by the full name; a parameter of ``link_variants`` replaces them.
NICKNAMES = {
    "alexander": ["alex", "sasha", "sandy", "xander", "alec"],
    "alexandra": ["lexi"],
    "andrew": ["andy", "drew"],
    "anthony": ["tony"],
    "barbara": ["barb", "babs"],
    "benjamin": ["ben", "benny", "benji"],
    "catherine": ["cathy"],
    "charles": ["charlie", "chuck"],
    "christina": ["tina", "chrissy"],
    "christopher": ["chris", "kit", "topher"],
    "daniel": ["dan", "danny"],
    "david": ["dave"],
    "deborah": ["deb", "debbie"],
    "dorothy": ["dot", "dottie"],
    "edward": ["ed", "eddie", "ned"],
    "eleanor": ["ellie", "nell", "nora"],
    "elizabeth": ["liz", "beth", "betty", "lizzie", "eliza", "libby", "betsy"],
    "frederick": ["fred", "freddie", "freddy"],
    "gabriela": ["gabi", "gaby"],
    "george": ["georgie"],
    "gregory": ["greg"],
    "henry": ["harry", "hank"],
    "isabella": ["bella", "izzy", "isa", "belle"],
    "james": ["jim", "jimmy", "jamie"],
    "jennifer": ["jen", "jenny"],
    "john": ["jack", "johnny"],
    "jonathan": ["jon", "jonny", "nathan"],
    "joseph": ["joe", "joey"],
    "josephine": ["josie", "jo", "fina"],
    "katherine": ["kate", "katie", "kathy", "kat", "kitty", "kathie"],
    "kenneth": ["ken", "kenny"],
    "lawrence": ["larry"],
    "leonard": ["len", "leo", "lenny"],
    "margaret": ["peggy", "maggie", "meg", "marge", "greta", "peg", "margie"],
    "matthew": ["matt", "matty"],
    "michael": ["mike", "mick", "mickey", "micky"],
    "nicholas": ["nick", "nicky"],
    "patricia": ["trish", "pat", "patty", "tricia", "patsy"],
    "penelope": ["penny", "nell"],
    "peter": ["pete"],
    "raymond": ["ray"],
    "rebecca": ["becky"],
    "richard": ["dick", "rick", "rich", "richie", "ricky"],
    "robert": ["bob", "rob", "bobby", "robbie", "bert"],
    "ronald": ["ron"],
    "samantha": ["sam", "sammy"],
    "stephen": ["steve"],
    "susannah": ["sue", "susie", "suzy", "susan"],
    "theodore": ["ted", "theo", "teddy"],
    "thomas": ["tom", "tommy"],
    "timothy": ["tim", "timmy"],
    "victoria": ["vicky", "tori", "vic", "vicki"],
    "william": ["bill", "will", "billy", "willy", "liam"],
    "zachary": ["zach", "zack", "zak"],
}
# Words, as a whole, that say that a name is an organisation's.
ORGANISATION = {"laboratory", "laboratories", "lab", "labs", "centre", "center", "centres", "centers", "ctr", "society", "societies", "soc", "department", "departments", "dept", "university", "universities", "univ", "institute", "institution", "institutes", "inst", "association", "assoc", "group", "groups", "wg", "council", "agency", "committee", "consortium", "faculty", "school", "academy", "college", "company", "corporation", "corp", "bureau", "office", "ministry", "foundation", "network", "team", "project", "collaboration"}
SMALL = {"the", "of", "for", "and", "in", "on", "de", "la", "a", "an", "&"}

_nick = {short: full for full, shorts in NICKNAMES.items() for short in shorts}
_token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?(?:-(?=[^\W\d_]))?")
FIELDS = "name string, n long, family string, given string, partial boolean, middle string, sure boolean, wide_family string, wide_given string"


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()) if not unicodedata.combining(c))


def _pieces(text: str) -> list[str]:
    """Name parts as typed; parts joined by a hyphen stay one part."""
    return ["".join(x) for x in (re.findall(_token, part) for part in re.sub(r"\.(?=[^\s\-.,])", ". ", text).split()) if x]


def _is_initials(piece: str, most: int = 3) -> bool:
    bare = re.sub(r"[.\-]", "", piece)
    return bool(bare) and (len(bare) == 1 or (len(bare) <= most and bare.isupper()) or (piece.endswith(".") and "-" in piece and all(len(x) == 1 for x in piece.strip(".").replace(".", "").split("-"))))


def _join(piece: str) -> str:
    return re.sub(r"[^\w]|_", "", fold(piece))


def _given(pieces: list[str], nick: dict[str, str] = _nick) -> tuple[str, bool, str]:
    """Given name, whether it is only its beginning, and the initials after it."""
    if not pieces:
        return "", True, ""
    head, rest = pieces[0], pieces[1:]
    if _is_initials(head):
        letters = [x for x in re.split(r"[.\-]", head) if x]
        if len(letters) == 1 and len(letters[0]) > 1:  # WM
            return fold(letters[0][0]), True, fold(letters[0][1:]) + "".join(_join(x)[:1] for x in rest)
        return fold(letters[0][0]), True, "".join(_join(x)[:1] for x in rest)
    given = _join(head)
    return nick.get(given, given), head.endswith("."), "".join(_join(x)[:1] for x in rest)


def _organisation(name: str) -> tuple[str, str, bool, str] | None:
    """Own name and initials of an organisation: a name of three words or more with a word that says so, or with of or for."""
    own, _, front = name.rpartition(",")
    words = _pieces(name)
    plain = {_join(w) for w in words}
    if len(words) < 3 or not (plain & ORGANISATION or plain & {"of", "for"}):
        return None
    if own and len(_pieces(front)) == 1:
        head, rest = _join(front), [w for w in _pieces(own) if _join(w) not in SMALL]
    else:
        keep = [w for w in words if _join(w) not in SMALL]
        head, rest = (_join(keep[0]), keep[1:]) if keep else ("", [])
    caps = any(c.islower() for c in name)
    letters = "".join(_join(w) if caps and w.isupper() and 1 < len(w) <= 3 else _join(w)[:1] for w in rest)
    return head, letters[:1], True, letters[1:]


def read_names(frames: Iterator[pd.DataFrame], nick: dict[str, str] = _nick) -> Iterator[pd.DataFrame]:
    """Spelling to family, given, partial, middle; not ``sure`` where the order of two plain words must be decided."""
    for pdf in frames:
        out = []
        for name, n in zip(pdf.name, pdf.n, strict=True):
            text = unicodedata.normalize("NFKC", name)
            if org := _organisation(text):
                out.append((name, n, *org, True, None, None))
                continue
            left, comma, right = text.partition(",")
            if comma:
                out.append((name, n, _join("".join(_pieces(left))), *_given(_pieces(right), nick), True, None, None))
                continue
            parts = _pieces(re.sub(r"(?<=[a-z])(?=[A-Z][a-z]+\s)", "-", text))
            if len(parts) < 2:
                out.append((name, n, _join("".join(parts)), "", True, "", True, None, None))
            elif not _is_initials(parts[0]) and all(_is_initials(p) for p in parts[1:]) and not parts[0].endswith("."):
                out.append((name, n, _join(parts[0]), *_given(parts[1:], nick), True, None, None))
            else:
                given, partial, middle = _given(parts[:-1], nick)
                # a blank can stand for the hyphen of a double family or given name
                wide = len(parts) > 2 and len(_join(parts[-2])) > 2
                both = _join(parts[0] + parts[1]) if len(parts) > 2 and len(_join(parts[1])) > 2 and not partial else None
                out.append((name, n, _join(parts[-1]), given, partial, middle, partial or len(parts) > 2 or len(given) < 2, _join(parts[-2] + parts[-1]) if wide else None, both))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FIELDS.split(", ")])


def profiles(names: DataFrame, nicknames: dict[str, list[str]] = NICKNAMES) -> DataFrame:
    """``(name, n, family, given, partial, middle)`` for distinct spellings ``(name, n)``.

    Two plain words can stand in either order: the word that is more often a given name elsewhere is taken for it.
    """
    nick_of = {short: full for full, shorts in nicknames.items() for short in shorts}
    read = materialize(names.mapInPandas(partial(read_names, nick=nick_of), FIELDS), "read")
    full = read.filter("NOT partial AND given <> ''")
    seen = full.select(F.col("given").alias("word"), F.lit(1).alias("as_given"), F.lit(0).alias("as_family")).union(full.select("family", F.lit(0), F.lit(1)))
    usage = seen.groupBy("word").agg(F.sum("as_given").alias("as_given"), F.sum("as_family").alias("as_family")).filter("as_given > as_family")
    common = usage.select("word", F.col("as_given").alias("used"))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in nick_of.items() for x in pair)), F.col("family")) if nick_of else F.lit(None)
    turned = read.filter("NOT sure").withColumn("family_as_given", F.coalesce(known, F.col("family")))
    turned = turned.join(common.select(F.col("word").alias("family_as_given"), F.col("used").alias("back")), "family_as_given")
    turned = turned.join(common.select(F.col("word").alias("given"), F.col("used").alias("front")), "given", "left").filter("front IS NULL OR back > 20 * front")
    swap = turned.select("name", F.col("given").alias("new_family"), F.col("family_as_given").alias("new_given"))
    families = read.filter("sure AND family <> ''").groupBy(F.col("family").alias("wide_family")).agg(F.count(F.lit(1)).alias("as_family"))
    givens = usage.select(F.col("word").alias("wide_given"), F.col("as_given").alias("as_wide"))
    read = read.join(families, "wide_family", "left").join(givens, "wide_given", "left")
    joined = read.join(swap, "name", "left")
    wide_family, wide_given = F.col("as_family").isNotNull(), F.col("as_wide") > 1
    return joined.select(
        "name",
        "n",
        F.when(wide_family, F.col("wide_family")).otherwise(F.coalesce("new_family", "family")).alias("family"),
        F.when(wide_given & ~wide_family, F.col("wide_given")).otherwise(F.coalesce("new_given", "given")).alias("given"),
        "partial",
        F.when(wide_family, F.expr("substring(middle, 1, length(middle) - 1)")).when(wide_given, F.substring("middle", 2, 9)).otherwise(F.col("middle")).alias("middle"),
    )


def one_left_out(text: str) -> list[str]:
    """The text itself and every form with one letter left out, for texts long enough to tell."""
    if len(text) < 5:
        return [text]
    return list(dict.fromkeys([text, *(text[:i] + text[i + 1 :] for i in range(len(text)))]))


def places_left_out(text: str) -> list[tuple[str, int, str]]:
    """``(form, place, letter)``: the forms of ``one_left_out`` with each place whose letter can be left out; -1 for the text itself."""
    if len(text) < 5:
        return [(text, -1, "")]
    return [(text, -1, ""), *((text[:i] + text[i + 1 :], i, text[i]) for i in range(len(text)))]


def close(a: str, b: str) -> bool:
    """Equal, or one letter wrong, lost, added or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _agree(a: str, b: str) -> bool:
    """Initials do not contradict each other: one begins with the other."""
    return a.startswith(b) or b.startswith(a)


KEYS = "node long, cluster long, n long, kind string, key string, place int, letter string, family string, given string, middle string"


def _full_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of full names: family with a letter left out and the given name; family and given with a letter left out."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            keys = [(f"f|{form}|{r.given}", *at) for form, *at in places_left_out(r.family)]
            if not r.partial:
                keys += [(f"g|{r.family}|{form}", *at) for form, *at in places_left_out(r.given)]
            for key, *at in keys:
                out.append((r.node, r.cluster, r.n, "any", key, *at, r.family, r.given, r.middle))
                out += [(r.node, r.cluster, r.n, "same", f"{key}|{r.middle[:k]}", *at, r.family, r.given, r.middle) for k in range(min(1, len(r.middle)), len(r.middle) + 1)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in KEYS.split(", ")])


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        good = [close(r.family, r.hub_family) and close(r.given, r.hub_given) and _agree(r.middle, r.hub_middle) for r in pdf.itertuples(index=False)]
        yield pdf.loc[good, ["cluster", "hub_cluster"]].rename(columns={"cluster": "a", "hub_cluster": "b"})


def _hub_edges(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between clusters of full names that are close and whose initials agree.

    A block is parted so that all members of a part are close: the names that lack no letter with all the others; names
    that lack a letter at the same place; names that lack the same letter at neighbouring places. In each part every
    profile faces the heaviest one. Every block also stands once per beginning of the initials. Where the initials in a block contradict each other it holds namesakes,
    and only the blocks per initial count: a name without initials is then linked to none of them.
    """
    keys = materialize(nodes.mapInPandas(_full_keys, KEYS), "keys")
    initial = F.when(F.col("middle") != "", F.substring("middle", 1, 1))
    several = keys.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.first("kind").alias("kind"), F.min(initial).alias("low_middle"), F.max(initial).alias("high_middle"))
    several = several.filter("low <> high AND (kind = 'same' OR low_middle IS NULL OR startswith(high_middle, low_middle))").select("key")
    swaps = [F.concat(F.lit("s"), F.col("place") - k, F.lit("|"), "letter") for k in (0, 1)]
    parts = F.when(F.col("place") < 0, F.array(F.lit("w"))).otherwise(F.array(F.lit("w"), F.concat(F.lit("p"), "place"), *swaps))
    spots = salted_join(keys, several, "key").withColumn("spot", F.explode(F.transform(parts, lambda p: F.concat_ws("|", "key", p))))
    spots = spots.withColumn("centre", F.col("spot") != F.concat_ws("|", "key", F.lit("w"))).withColumn("centre", F.col("centre") | (F.col("place") < 0))
    spots = materialize(spots.select("spot", "centre", "node", "cluster", "n", "family", "given", "middle"), "spots")
    hubs = spots.groupBy("spot").agg(F.max_by(F.struct("cluster", "family", "given", "middle"), F.when(F.col("centre"), F.struct("n", F.length("middle"), "node"))).alias("hub"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    hubs = hubs.filter("low <> high AND hub IS NOT NULL").select("spot", F.col("hub.cluster").alias("hub_cluster"), F.col("hub.family").alias("hub_family"), F.col("hub.given").alias("hub_given"), F.col("hub.middle").alias("hub_middle"))
    facing = salted_join(spots, hubs, "spot").filter("cluster <> hub_cluster")
    return facing.select("cluster", "family", "given", "middle", "hub_cluster", "hub_family", "hub_given", "hub_middle").distinct().mapInPandas(_verified, "a long, b long")


def _short_keys(whole: bool):
    """Keys under which a full name can be meant by a shortened one: a full name answers to all of its beginnings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                sizes = range(1, len(r.given) + 1) if whole else [len(r.given)]
                middles = dict.fromkeys(["", *(r.middle[:i] for i in range(1, len(r.middle) + 1))]) if whole else [r.middle]
                for size in sizes:
                    for middle in middles:
                        out.append((r.node, r.cluster, "exact", f"{r.family}|{r.given[:size]}|{middle}"))
                        # a typing error in the family name counts beside a single initial
                        if size == 1:
                            out += [(r.node, r.cluster, "near", f"{form}|{r.given[:size]}|{middle}") for form in one_left_out(r.family)]
            yield pd.DataFrame(out, columns=["node", "cluster", "kind", "key"])

    return run


def _short_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each shortened name to the one cluster of full names it can stand for; none where there are several.

    The family name as typed goes first; one letter off counts only for names that nobody bears as typed. Two complete
    given names are not linked because one begins the other (Paul, Paula): that takes the table of short forms.
    """
    schema = "node long, cluster long, kind string, key string"
    full = nodes.filter("NOT partial AND given <> ''").mapInPandas(_short_keys(True), schema)
    short = materialize(nodes.filter("partial AND given <> ''").mapInPandas(_short_keys(False), schema), "short")
    answer = full.groupBy("kind", "key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    answer = answer.select(F.concat_ws(":", "kind", "key").alias("block"), "low", "high")
    met = salted_join(short.withColumn("block", F.concat_ws(":", "kind", "key")), answer, "block")
    by = met.groupBy("node", "cluster", "kind").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    exact = by.filter("kind = 'exact'").select("node", "cluster", F.col("low").alias("e_low"), F.col("high").alias("e_high"))
    near = by.filter("kind = 'near'").select("node", "cluster", "low", "high")
    both = near.join(exact, ["node", "cluster"], "full").select("node", "cluster", F.coalesce("e_low", "low").alias("low"), F.coalesce("e_high", "high").alias("high"))
    return both.filter("low = high AND cluster <> low").select(F.col("cluster").alias("a"), F.col("low").alias("b")).distinct()


def _unite(nodes: DataFrame) -> DataFrame:
    """Profiles take the longest initials of their cluster where all of the cluster's agree."""
    longest = nodes.groupBy("cluster").agg(F.max_by("middle", F.struct(F.length("middle"), "middle")).alias("longest"))
    facing = materialize(salted_join(nodes, longest, "cluster"), "longest")
    agreed = facing.groupBy("cluster").agg(F.bool_and(F.startswith("longest", "middle")).alias("agreed"))
    return salted_join(facing, agreed, "cluster").withColumn("middle", F.when(F.col("agreed"), F.col("longest")).otherwise(F.col("middle"))).drop("longest", "agreed")


def _namesakes_apart(nodes: DataFrame) -> DataFrame:
    """Edges that complete full names lacking initials: to the only bearer of the same name with initials."""
    same = nodes.filter("NOT partial").withColumn("both", F.concat_ws("|", "family", "given"))
    bearers = same.groupBy("both").agg(F.min(F.when(F.col("middle") != "", F.col("middle"))).alias("low"), F.max(F.when(F.col("middle") != "", F.col("middle"))).alias("high"), F.max_by("cluster", F.struct(F.length("middle"), "n", "node")).alias("hub"))
    bearers = bearers.filter("low IS NULL OR startswith(high, low)").select("both", "hub")
    return salted_join(same, bearers, "both").filter("cluster <> hub").select(F.col("cluster").alias("a"), F.col("hub").alias("b")).distinct()


def link_variants(names: DataFrame, nicknames: dict[str, list[str]] = NICKNAMES, most_rounds: int = 100) -> DataFrame:
    """``(name, author)``: spellings ``names (name)`` with the id of the author they mean, one row per distinct spelling.

    Null names are left out, empty ones and names without a letter stand alone; repeated rows add weight. Namesakes
    with different initials stay apart, and a short form that fits several authors is linked to none of them. Rounds go
    on until none merges; more than ``most_rounds`` of them are an error.
    """
    distinct = names.filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    read = materialize(profiles(distinct, nicknames), "profiles")
    node = F.when((F.col("family") == "") | F.col("family").isNull(), F.xxhash64(F.lit("alone"), "name")).otherwise(F.xxhash64("family", "given", "partial", "middle"))
    read = materialize(read.withColumn("node", node), "nodes")
    nodes = read.filter("family <> ''").groupBy("node", "family", "given", "partial", "middle").agg(F.sum("n").alias("n")).withColumn("cluster", F.col("node"))
    nodes = materialize(nodes, "nodes")
    steps = [_namesakes_apart, _hub_edges, _short_edges]
    quiet = 0
    for turn in range(most_rounds * len(steps)):
        with intermediates() as kept:
            edges = materialize(steps[turn % len(steps)](nodes), "links")
            quiet = quiet + 1 if edges.isEmpty() else 0
            if quiet == len(steps):
                break
            if quiet:
                continue
            roots = components(edges).select(F.col("node").alias("cluster"), "root")
            merged = salted_join(nodes, roots, "cluster", "left").withColumn("cluster", F.coalesce("root", "cluster")).drop("root")
            merged = materialize(merged.select("node", "cluster", "n", "family", "given", "partial", "middle"), "merged")
            before, nodes = nodes, kept(materialize(_unite(merged), "nodes"))
        discard(before)
    else:
        raise RuntimeError(f"names still merge after {most_rounds} rounds")
    return read.join(nodes.select("node", "cluster"), "node", "left").select("name", F.coalesce("cluster", "node").alias("author"))


def variant_pairs(linked: DataFrame, cell: int = 500) -> DataFrame:
    """``(name_a, name_b)``: different spellings of one author, the smaller by code point first.

    The spellings of an author are cut into parts of about ``cell``, so that no task pairs off a large group alone.
    """
    sizes = linked.groupBy("author").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("author", F.ceil(F.col("n") / cell).alias("parts"))
    members = materialize(salted_join(linked, sizes, "author"), "members")
    a = members.select(F.col("name").alias("name_a"), "author", F.pmod(F.xxhash64("name"), "parts").alias("part"))
    b = members.select(F.col("name").alias("name_b"), "author", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["author", "part"]).filter("name_a < name_b").select("name_a", "name_b")
