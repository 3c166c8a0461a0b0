"""Records of people: links between names, each record's best match, records merged into people.

A record has seq (unique, its place in the order), full_name, profile (an account's id) and emails
(lower case). Two records' score: equal profiles 100, different ones 0; else a shared address 100;
else, of names, 100 if one contains the other, or the similarity of their sorted words; else the
similarity of one's name and the local part of the other's address, from 90 on. From SAME on they match.

Names meet by the similarity joins, which lose nothing, as distinct names: a frequent name is one row.
Of the holders of a name, an address or a profile the two earliest are all that a best match needs.

Merging follows the order, so what a record does depends on those before it. Records that no chain of
equal profiles, addresses or similar names links can't affect each other, whatever merges: a merged
record has nothing that was not one of its members'. So each such group is folded by itself, in one
task, at about 300 bytes a record and 100 a link. The links that make the groups are all pairs of names,
and of names and addresses, that can match, so a fold looks up a record's few and scores those only;
where it is not given them, marks of 128 bits (see similar) of all tell what may match.

Cases: null names and profiles count as empty, null lists as none; records without anything match
nothing; equal records are records each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import common_characters
from foliant.operators.components import connected
from foliant.operators.similar import contained, marks, similar
from foliant.tables import settled

#: Scores from which two records are one person, and a name and a local part are.
SAME, LOCAL = 85, 90
#: Records of a bucket of groups, where no group is larger.
GROUPED = 5000


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _local(email: str) -> str:
    """The local part of an address with its separators as blanks."""
    return re.sub(r"[._+\-]+", " ", email.split("@", 1)[0])


def _slug(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return " ".join(re.split(r"[^a-z0-9]+", plain.lower())).strip()


def _normal(text: str) -> str:
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


def _hints(profile: str, emails: list[str]) -> list[str]:
    """Names that an account's id and addresses suggest."""
    own = [_normal(_local(e)) for e in emails] + [_normal(re.sub(r"-?\d+$", "", profile))]
    return list(dict.fromkeys(h for h in own if h))


def prepared(records: DataFrame) -> DataFrame:
    """The records with the forms of their names, addresses and ids that are compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            emails = [list(e) for e in frame["emails"]]
            yield frame.assign(
                emails=emails,
                lower=[n.lower() for n in frame["full_name"]],
                words=[_sorted_words(n.lower()) for n in frame["full_name"]],
                slug=[_sorted_words(_slug(n)) for n in frame["full_name"]],
                normal=[_sorted_words(_normal(n)) for n in frame["full_name"]],
                locals=[sorted({_sorted_words(_local(e)) for e in own}) for own in emails],
                hints=[sorted({_sorted_words(h) for h in _hints(p, own)}) for p, own in zip(frame["profile"], emails)],
            )

    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    own = records.select(F.col("seq").cast("long"), text("full_name"), text("profile"), F.coalesce("emails", F.array().cast("array<string>")).alias("emails"))
    forms = "lower string, words string, slug string, normal string, locals array<string>, hints array<string>"
    return own.mapInPandas(run, f"seq bigint, full_name string, profile string, emails array<string>, {forms}")


def _links(names: DataFrame) -> DataFrame:
    """a, b (a before b) and score of distinct names (lower, words)."""
    inside = contained(names.select(F.col("lower").alias("s"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(100.0).alias("score"))
    alike = similar(names.select(F.col("words").alias("s")).distinct(), percent=SAME)
    equal = names.select(F.col("words").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(100.0).alias("score"))
    x, y = (names.select(F.col("words").alias(w), F.col("lower").alias(n)) for w, n in (("a", "one"), ("b", "other")))
    alike = alike.union(equal).join(x, "a").join(y, "b").where("one <> other")
    alike = alike.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "score")
    return inside.union(alike).groupBy("a", "b").agg(F.max("score").alias("score"))


def name_links(records: DataFrame) -> DataFrame:
    """a, b and score: distinct lower-case names of records that are SAME or more alike, a before b."""
    return _links(settled(prepared(records).where("lower <> ''").select("lower", "words").distinct()))


def _earliest(rows: DataFrame, *key: str) -> DataFrame:
    """key, mode, first and second: the two earliest holders of a key, any, and of those without a profile (free)."""
    modes = F.explode(F.when(F.col("profile") == "", F.array(F.lit("any"), F.lit("free"))).otherwise(F.array(F.lit("any"))))
    held = rows.select(*key, "seq", modes.alias("mode"))
    first = held.groupBy(*key, "mode").agg(F.min("seq").alias("first"))
    second = held.join(first, [*key, "mode"]).where("seq > first").groupBy(*key, "mode").agg(F.min("seq").alias("second"))
    return first.join(second, [*key, "mode"], "left")


def best_matches(records: DataFrame, least: int = SAME) -> DataFrame:
    """one, other, score: each record's best match from a score on, ties to the earlier record.

    A record with a profile matches records of that profile only, if there are others.
    """
    p = settled(prepared(records))
    own = p.withColumn("mode", F.when(F.col("profile") == "", "any").otherwise("free"))
    other = F.when(F.col("seq") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other")
    known = p.where("lower <> ''")
    names = settled(known.select("lower", "words", "slug").distinct())
    by_name = settled(_earliest(known, "lower"))

    same_profile = own.where("profile <> ''").join(_earliest(p.where("profile <> ''"), "profile").where("mode = 'any'").drop("mode"), "profile").select("seq", other).where("other IS NOT NULL")
    exact = same_profile.select("seq", "other", F.lit(100.0).alias("score"))

    emails = lambda rows: rows.withColumn("email", F.explode(F.array_distinct("emails")))
    mailed = emails(own).join(_earliest(emails(p), "email"), ["email", "mode"]).select("seq", other, F.lit(100.0).alias("score"))
    named = own.join(by_name, ["lower", "mode"]).select("seq", other, F.lit(100.0).alias("score"))

    links = settled(_links(names))
    both = links.union(links.select("b", "a", "score"))
    lead = by_name.select(F.col("lower").alias("b"), "mode", "first")
    best = lambda rows, *key: rows.groupBy(*key, "mode").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("first").alias("o"))).alias("m"))
    alike = best(both.join(lead, "b"), "a").withColumnRenamed("a", "lower")
    alike = own.join(alike, ["lower", "mode"]).select("seq", F.col("m.o").alias("other"), (-F.col("m.s")).alias("score"))

    # A name against the local part of an address counts where there are no two names, or they have no character in common.
    located = p.withColumn("local", F.explode("locals"))
    spelled = similar(names.select(F.col("slug").alias("s")).distinct(), located.select(F.col("local").alias("s")).distinct(), LOCAL)
    spelled = settled(spelled.select(F.col("a").alias("slug"), F.col("b").alias("local"), "score"))
    apart = (F.col("lower") == "") | (F.size(F.array_intersect(F.split("words", ""), F.split("their_words", ""))) == 0)
    theirs = names.select("slug", F.col("lower").alias("b"), F.col("words").alias("their_words"))
    ours = located.select("lower", "words", "local").distinct()
    to_name = ours.join(spelled, "local").join(theirs, "slug").where(apart).select("lower", "local", "b", "score")
    to_name = best(to_name.join(lead, "b"), "lower", "local")
    to_name = own.withColumn("local", F.explode("locals")).join(to_name, ["lower", "local", "mode"]).select("seq", F.col("m.o").alias("other"), (-F.col("m.s")).alias("score"))
    holders = ours.select("lower", "words", "local").join(spelled, "local").join(theirs, "slug").where(apart).select("lower", "local", "b", "score")
    to_mail = best(holders.join(_earliest(located, "lower", "local"), ["lower", "local"]), "b").withColumnRenamed("b", "lower")
    to_mail = own.join(to_mail, ["lower", "mode"]).select("seq", F.col("m.o").alias("other"), (-F.col("m.s")).alias("score"))

    rest = mailed.union(named).union(alike).union(to_name).union(to_mail).where(F.col("other").isNotNull() & (F.col("score") >= least)).join(exact.select("seq"), "seq", "left_anti")
    found = exact.union(rest).groupBy("seq").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("other").alias("o"))).alias("m"))
    return found.select(F.col("seq").alias("one"), F.col("m.o").alias("other"), (-F.col("m.s")).alias("score"))


def _matches(p: DataFrame, grouped: bool) -> tuple[DataFrame, DataFrame]:
    """a and b: all pairs of distinct names that can match, and all of names with what addresses or ids suggest."""
    name, other = ("normal", "hints") if grouped else ("slug", "locals")
    strings, told = p.select(F.col(name).alias("s")).where("s <> ''").distinct(), p.select(F.explode(other).alias("s")).distinct()
    near = similar(strings, percent=SAME) if grouped else _links(settled(p.where("lower <> ''").select("lower", "words").distinct()))
    return settled(near.select("a", "b")), settled(similar(strings, told, SAME if grouped else LOCAL).select("a", "b"))


def _groups(p: DataFrame, grouped: bool, near: DataFrame, apart: DataFrame) -> DataFrame:
    """The records with component: those that can affect each other. Holders of a value are linked with its earliest one only."""

    def star(rows: DataFrame, value: str) -> DataFrame:
        held = rows.select("seq", F.col(value).alias("value")).where("value <> ''")
        first = held.groupBy("value").agg(F.min("seq").alias("first"))
        return held.join(first, "value").where("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b"))

    first = lambda rows, value, name: rows.where(F.col(value) != "").groupBy(F.col(value).alias(name)).agg(F.min("seq").alias(f"{name}_seq"))
    met = lambda pairs, x, y: pairs.join(x, "a").join(y, "b").select("a_seq", "b_seq")
    told = p.withColumn("told", F.explode("hints" if grouped else "locals"))
    links = star(p, "profile").union(star(p.withColumn("email", F.explode("emails")), "email")).union(star(told, "told"))
    for value in ("normal",) if grouped else ("lower", "slug"):
        links = links.union(star(p, value))
    name, beside = ("normal", "normal") if grouped else ("lower", "slug")
    links = links.union(met(near, first(p, name, "a"), first(p, name, "b"))).union(met(apart, first(p, beside, "a"), first(told, "told", "b")))
    return p.join(connected(settled(links.where("a <> b"))).select(F.col("node").alias("seq"), "component"), "seq", "left").withColumn("component", F.coalesce("component", "seq"))


class Person:
    """A person of the fold: what its records brought."""

    __slots__ = ("seq", "full_name", "profile", "emails", "members")

    def __init__(self, seq: int, full_name: str, profile: str, emails: list[str]):
        self.seq, self.full_name, self.profile, self.emails, self.members = seq, full_name, profile, list(dict.fromkeys(emails)), [seq]

    def take(self, other: Person) -> None:
        """The longer name, the first profile, all addresses."""
        if len(other.full_name) > len(self.full_name):
            self.full_name = other.full_name
        self.profile = self.profile or other.profile
        self.emails = list(dict.fromkeys(self.emails + other.emails))
        self.members += other.members


def _alike(x: str, y: str) -> float:
    """Similarity of the sorted words of two strings."""
    x, y = _sorted_words(x), _sorted_words(y)
    return 200.0 * common_characters(x, y) / (len(x) + len(y)) if x and y else 0.0


def score(p: Person, q: Person) -> float:
    """0 to 100 that two people are one."""
    if p.profile and q.profile:
        return 100.0 if p.profile == q.profile else 0.0
    if not set(p.emails).isdisjoint(q.emails):
        return 100.0
    if p.full_name and q.full_name:
        x, y = p.full_name.lower(), q.full_name.lower()
        if x in y or y in x:
            return 100.0
        if found := _alike(x, y):
            return found
    best = max((_alike(_slug(a.full_name), _local(e)) for a, b in ((p, q), (q, p)) if a.full_name for e in b.emails), default=0.0)
    return best if best >= LOCAL else 0.0


class Marks:
    """Strings with their marks, each of an owner (a number), to find the owners of those that can be like another one."""

    def __init__(self):
        self.low, self.high, self.sizes, self.owners = np.zeros(256, np.uint64), np.zeros(256, np.uint64), np.zeros(256, np.int32), np.zeros(256, np.int64)
        self.texts: list[str] = []

    def add(self, owner: int, text: str) -> int:
        """The number of the entry."""
        n = len(self.texts)
        if n == len(self.sizes):
            self.low, self.high, self.sizes, self.owners = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high, self.sizes, self.owners))
        self.low[n], self.high[n] = marks([text])[0]
        self.sizes[n], self.owners[n] = len(text), owner
        self.texts.append(text)
        return n

    def drop(self, entry: int) -> None:
        """An entry that is found no more."""
        self.sizes[entry] = 0

    def near(self, text: str, percent: int) -> list[int]:
        """Owners of strings whose marks allow a similarity of percent."""
        if not text:
            return []
        (low, high), n = marks([text])[0], len(self.texts)
        off = np.bitwise_count(self.low[:n] ^ low) + np.bitwise_count(self.high[:n] ^ high)
        return self.owners[:n][(off <= (100 - percent) * (self.sizes[:n] + len(text)) // 100) & (self.sizes[:n] > 0)].tolist()

    def parts(self, text: str) -> list[int]:
        """Owners of strings that contain the text or stand in it."""
        if not text:
            return []
        (low, high), n = marks([text])[0], len(self.texts)
        a, b = self.low[:n] & low, self.high[:n] & high
        hit = np.flatnonzero((((a == low) & (b == high)) | ((a == self.low[:n]) & (b == self.high[:n]))) & (self.sizes[:n] > 0))
        return [int(self.owners[i]) for i in hit if text in self.texts[i] or self.texts[i] in text]


class Linked:
    """Strings, each of an owner, to find the owners of those that links name, or of equal ones. Used as Marks are."""

    def __init__(self, links: dict[str, list[str]]):
        self.links, self.owners = links, {}
        self.entries: list[tuple[str, int]] = []

    def add(self, owner: int, text: str) -> int:
        self.owners.setdefault(text, set()).add(owner)
        self.entries.append((text, owner))
        return len(self.entries) - 1

    def drop(self, entry: int) -> None:
        text, owner = self.entries[entry]
        self.owners[text].discard(owner)

    def parts(self, text: str) -> list[int]:
        if not text:
            return []
        found = list(self.owners.get(text, ()))
        for other in self.links.get(text, ()):
            found += self.owners.get(other, ())
        return found

    def near(self, text: str, percent: int) -> list[int]:
        return self.parts(text)


class Links:
    """All pairs of names that can match (near), and of names with what addresses or ids suggest (apart)."""

    def __init__(self, near: Iterable[tuple[str, str]], apart: Iterable[tuple[str, str]]):
        self.near: dict[str, list[str]] = {}
        self.told: dict[str, list[str]] = {}
        self.names: dict[str, list[str]] = {}
        for a, b in near:
            self.near.setdefault(a, []).append(b)
            self.near.setdefault(b, []).append(a)
        for a, b in apart:
            self.told.setdefault(a, []).append(b)
            self.names.setdefault(b, []).append(a)


class Known:
    """The people of a fold by what a record can match: every match is among the candidates, by their number in the order."""

    def __init__(self, links: Links | None = None):
        self.people: list[Person | None] = []
        self.entries: dict[int, list[tuple[Marks, int]]] = {}
        self.profiles: dict[str, set[int]] = {}
        self.emails: dict[str, set[int]] = {}
        self.lowers, self.words, self.slugs, self.locals = (Linked(x) for x in (links.near, {}, links.names, links.told)) if links else (Marks() for _ in range(4))

    def _put(self, at: int, name: str | None, emails: list[str]) -> None:
        """What is new of a person: its name, if it has another one, and addresses."""
        if name is not None:
            self._drop(at)
            texts = (self.lowers, name.lower()), (self.words, _sorted_words(name.lower())), (self.slugs, _sorted_words(_slug(name)))
            self.entries[at] = [(held, held.add(at, text)) for held, text in texts if text]
        if self.people[at].profile:
            self.profiles.setdefault(self.people[at].profile, set()).add(at)
        for e in emails:
            self.emails.setdefault(e, set()).add(at)
            if local := _sorted_words(_local(e)):
                self.locals.add(at, local)

    def _drop(self, at: int) -> None:
        for held, entry in self.entries.pop(at, ()):
            held.drop(entry)

    def new(self, person: Person) -> None:
        self.people.append(person)
        self._put(len(self.people) - 1, person.full_name, person.emails)

    def take(self, at: int, other: Person) -> None:
        person = self.people[at]
        name, n = person.full_name, len(person.emails)
        person.take(other)
        self._put(at, person.full_name if person.full_name != name else None, person.emails[n:])

    def remove(self, at: int) -> None:
        self._drop(at)
        self.people[at] = None

    def candidates(self, person: Person) -> list[int]:
        """Numbers of people that the person may match, in order."""
        found = set(self.profiles.get(person.profile, ())) if person.profile else set()
        for e in person.emails:
            found |= self.emails.get(e, set())
            found.update(self.slugs.near(_sorted_words(_local(e)), LOCAL))
        lower = person.full_name.lower()
        found.update(self.lowers.parts(lower), self.words.near(_sorted_words(lower), SAME), self.locals.near(_sorted_words(_slug(person.full_name)), LOCAL))
        return sorted(i for i in found if self.people[i] is not None)


def fold(records: list[Person], links: Links | None = None) -> list[Person]:
    """Each record joins its best match among the people so far, who then takes all others that match it now.

    Only people that links name, or whose marks allow a match, are compared. links: near of names in
    lower case, apart of slugs and local parts.
    """
    known = Known(links)
    people = known.people
    for record in records:
        same = sorted(i for i in known.profiles.get(record.profile, ()) if people[i] is not None) if record.profile else []
        best, at = SAME, None
        for i in same or known.candidates(record):
            if (s := score(people[i], record)) > best or at is None and s == best:
                best, at = s, i
        if at is None:
            known.new(record)
            continue
        known.take(at, record)
        found, waiting = people[at], known.candidates(people[at])
        while waiting:
            i = heapq.heappop(waiting)
            if i != at and score(found, people[i]) >= SAME:
                known.take(at, people[i])
                known.remove(i)
                # What it has now may match others further on; those before have been asked.
                waiting = [j for j in known.candidates(found) if j > i]
    return [p for p in people if p is not None]


def grouped_fold(records: list[Person], links: Links | None = None) -> list[Person]:
    """Another order: records with profiles, with names and addresses, with addresses only, then others.

    Equal profiles join. Records of addresses only join the first holder of one. Else the holders of an
    address, or all people where there is none, are compared by names and hints: above SAME the best is joined.
    links: near of normal names, apart of those and hints.
    """
    people: list[Person] = []
    by_email: dict[str, set[int]] = {}
    by_profile: dict[str, int] = {}
    names, hinted = Marks(), Marks()
    if links:
        both = links.near.keys() | links.names.keys()
        names, hinted = Linked({x: [*links.near.get(x, ()), *links.names.get(x, ())] for x in both}), Linked(links.told)
    entries: list[tuple[str, int]] = []
    told: list[tuple[str, list[str]]] = []
    for record in sorted(records, key=lambda r: 0 if r.profile else (1 if r.full_name.strip() else 2) if r.emails else 3):
        at = by_profile.get(record.profile) if record.profile else None
        if at is None and not record.profile:
            holders = set().union(*[by_email.get(e, ()) for e in record.emails])
            if holders and not record.full_name.strip():
                at = min(holders)
            else:
                best = float(SAME)
                name, hints = _normal(record.full_name), _hints(record.profile, record.emails)
                if not holders:
                    own = _sorted_words(name)
                    holders = {*names.near(own, SAME), *hinted.near(own, SAME)}.union(*[names.near(_sorted_words(h), SAME) for h in hints])
                for i in sorted(holders):
                    theirs, their_hints = told[i]
                    pairs = [(name, x) for x in (theirs, *their_hints)] + [(x, theirs) for x in hints]
                    if (s := max(_alike(x, y) for x, y in pairs)) > best:
                        best, at = s, i
        if at is None:
            at = len(people)
            people.append(record)
            told.append(("", []))
            entries.append(("", -1))
            if record.profile:
                by_profile[record.profile] = at
        else:
            people[at].take(record)
        name, hints = _normal(people[at].full_name), _hints(people[at].profile, people[at].emails)
        if name != entries[at][0]:
            if entries[at][1] >= 0:
                names.drop(entries[at][1])
            entries[at] = name, names.add(at, _sorted_words(name)) if name else -1
        for h in set(hints).difference(told[at][1]):
            hinted.add(at, _sorted_words(h))
        told[at] = name, hints
        for e in people[at].emails:
            by_email.setdefault(e, set()).add(at)
    return people


def merged(records: DataFrame, grouped: bool = False) -> DataFrame:
    """person (seq of its first record), members, full_name, profile and emails: records folded into people."""
    policy = grouped_fold if grouped else fold
    columns = ["full_name", "profile", "emails"]

    def run(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        pairs = lambda near: zip(*(links[c][links["near"] == near] for c in "ab"))
        known, people = Links(pairs(True), pairs(False)), []
        for _, own in rows.sort_values("seq").groupby("component", sort=False):
            people += policy([Person(int(s), n, p, list(e)) for s, n, p, e in zip(own["seq"], *(own[c] for c in columns))], known)
        return pd.DataFrame({"person": [p.seq for p in people], "members": [sorted(p.members) for p in people], **{c: [getattr(p, c) for p in people] for c in columns}})

    p = settled(prepared(records))
    near, apart = _matches(p, grouped)
    linked = settled(_groups(p, grouped, near, apart))
    held = linked.groupBy("component").agg(F.count("*").alias("n"))
    alone = linked.join(held.where("n = 1").select("component"), "component", "left_semi").select(F.col("seq").alias("person"), F.array("seq").alias("members"), "full_name", "profile", F.array_distinct("emails").alias("emails"))
    many = settled(linked.join(held.where("n > 1").select("component"), "component", "left_semi"))
    # Groups are dealt in buckets, each with the links of its names.
    deal = F.pmod(F.xxhash64("component"), F.lit(many.count() // GROUPED + 1)).alias("bucket")
    of = lambda c: many.where(F.col(c) != "").groupBy(F.col(c).alias("a")).agg(F.min("component").alias("component"))
    name, beside = ("normal", "normal") if grouped else ("lower", "slug")
    links = near.join(of(name), "a").withColumn("near", F.lit(True)).union(apart.join(of(beside), "a").withColumn("near", F.lit(False))).select(deal, "a", "b", "near")
    rows = many.select(deal, "component", "seq", *columns)
    return rows.groupBy("bucket").cogroup(links.groupBy("bucket")).applyInPandas(run, "person bigint, members array<bigint>, full_name string, profile string, emails array<string>").union(alone)


def merge_metrics(records: DataFrame, people: DataFrame) -> DataFrame:
    """metric and n: records, people, and the distinct names, profiles and addresses of records that no person has any more."""
    lists = lambda df: df.select(F.explode("emails").alias("v")).distinct()
    values = lambda df, c: df.where(F.col(c) != "").select(F.col(c).alias("v")).distinct()
    counts = [("records", records), ("people", people), ("lost_emails", lists(records).join(lists(people), "v", "left_anti"))]
    counts += [(f"lost_{c}s", values(records, c).join(values(people, c), "v", "left_anti")) for c in ("full_name", "profile")]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.union(one)
    return out
