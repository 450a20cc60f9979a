"""Entity linkers over articles: by hyperlinks, by hyperlinks and names seen in the article, by popularity.

Resolution, aliases and names are joins. Only the scan of one article's text, in which each step depends on
what was accepted before, runs in Arrow batches; it keeps no state between articles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import mappings
from .resolve import link_to_id, not_other

MENTIONS = "article_id long, start int, end int, entity_id string, recognized_by string, linked_by string"
# Types by name.
PERSON, FICTIONAL, ORGANISATION = "Q5", "Q95074", "Q43229"
# Words that are no names at the start of a sentence.
PRONOUNS = frozenset({"he", "she", "it", "they", "we", "i", "you", "this", "that"})


def by_hyperlinks(articles: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """A mention for each hyperlink whose target resolves, with its raw span."""
    found = link_to_id(mappings.links(articles), "target", titles, redirects).where("entity_id is not null")
    return found.select(F.col("id").alias("article_id"), "start", "end", "entity_id", F.lit("HYPERLINK").alias("recognized_by"), F.lit("HYPERLINK").alias("linked_by"))


def middle_name_variants(name: Column) -> Column:
    """Four shorter forms of names of three parts or more, each beginning with a capital; else none."""
    parts = F.split(name, " ")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    initials = lambda dot, between: F.concat_ws(" ", first, F.array_join(F.transform(middle, lambda m: F.concat(F.substring(m, 1, 1), F.lit(dot))), between), last)
    fine = (F.size(parts) > 2) & F.forall(parts, lambda p: F.rlike(p, F.lit(r"^\p{Lu}")))
    forms = F.array(initials("", " "), initials(".", ""), initials(".", " "), F.concat_ws(" ", first, last))
    return F.when(fine, forms).otherwise(F.array().cast("array<string>"))


def may_vary(types: Column) -> Column:
    """Persons and fictional characters that are not organisations too."""
    return F.arrays_overlap(types, F.array(F.lit(PERSON), F.lit(FICTIONAL))) & ~F.array_contains(types, ORGANISATION)


def synonyms(aliases: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """entity_id, surfaces, variants: aliases that are not all lower case (in their order), and middle-name variants of the name.

    The two are apart because an alias gives way to what an article has already, while a variant takes its place.
    """
    own = aliases.select("entity_id", F.filter("aliases", lambda a: ~tx.is_all_lower(a)).alias("surfaces"))
    people = names.join(types, "entity_id").where(may_vary(F.col("types")))
    variants = people.select(F.col("entity_id").alias("_e"), middle_name_variants(F.col("name")).alias("variants")).where(F.size("variants") > 0)
    both = own.join(variants, F.col("entity_id") == F.col("_e"), "full_outer")
    return both.select(F.coalesce("entity_id", "_e").alias("entity_id"), "surfaces", "variants")


def given_names(names: DataFrame) -> DataFrame:
    """entity_id, given: first part of names with a space, if longer than a character."""
    given = F.element_at(F.split("name", " "), 1)
    return names.where(F.contains("name", F.lit(" ")) & (F.length(given) > 1)).select("entity_id", given.alias("given"))


def _prepared(articles: DataFrame, titles, redirects, names, types, aliases) -> DataFrame:
    """One row an article: its text, title entity, bold spans, and links with entity, synonyms and given name."""
    heads = articles.select("id", "title", "text", "title_synonyms")
    title = link_to_id(heads.select("id", "title"), "title", titles, redirects).select("id", F.col("entity_id").alias("title_entity"))
    kinds = types.select(F.col("entity_id").alias("_e"), not_other(F.col("types")).alias("_fine"))
    title = title.join(kinds, F.col("title_entity") == F.col("_e"), "left").select("id", "title_entity", F.coalesce("_fine", F.lit(True)).alias("title_fine"))
    links = link_to_id(mappings.links(articles), "target", titles, redirects).where("entity_id is not null")
    typed = links.join(types.withColumnRenamed("entity_id", "_e"), F.col("entity_id") == F.col("_e"), "left").drop("_e")
    fine = typed.where(F.coalesce(not_other(F.col("types")), F.lit(True)))
    rows = fine.select("id", F.struct("start", "end", "target", "entity_id").alias("link"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list("link")).alias("links"))
    used = fine.select("id", "entity_id").unionByName(title.where("title_entity is not null").select("id", F.col("title_entity").alias("entity_id"))).distinct()
    known = synonyms(aliases, names, types)
    people = given_names(names.join(types, "entity_id").where(F.array_contains("types", PERSON)).select("entity_id", "name"))
    facts = used.join(known, "entity_id", "left").join(people, "entity_id", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "surfaces", "variants", "given"))).alias("facts"))
    out = heads.join(title, "id", "left").join(listed, "id", "left").join(facts, "id", "left")
    return out


class ArticleScan:
    """Mentions of one article, in the order of the rules: bold titles, hyperlinks, then known names by length.

    ``links`` holds texts that were links (the last entity wins, at the place of the first), ``synonyms`` names of linked entities:
    an alias, the title without brackets and a given name only where there is none yet, a middle-name variant always. Links are
    looked for before synonyms, longer texts before shorter ones, and equally long ones in the order they came.
    """

    def __init__(self, text: str, title: str, title_entity, bold, links, facts, title_fine: bool = True):
        self.text, self.covered, self.found = text, bytearray(len(text) + 1), []
        some = lambda x: [] if x is None else list(x)
        self.names = {f["entity_id"]: (some(f["surfaces"]), some(f["variants"])) for f in facts}
        self.given = {f["entity_id"]: f["given"] for f in facts if f["given"]}
        self.links: dict[str, str] = {}
        self.synonyms: dict[str, str] = {}
        if title_entity:
            self.links[title] = title_entity
            self._add_synonyms(title_entity)
            short = re.sub(r" \([^)]*?\)", "", title)
            if short != title:
                self.synonyms.setdefault(short, title_entity)
            for b in bold if title_fine else ():
                self._link(b["start"], b["end"], title, title_entity)
        for x in links:
            self._link(x["start"], x["end"], x["target"], x["entity_id"])
        for e in [title_entity, *(x[2] for x in self.found)]:
            if e in self.given:
                self.synonyms.setdefault(self.given[e], e)
        for table in (self.links, self.synonyms):
            for surface in sorted(table, key=len, reverse=True):
                self._occurrences(surface, table[surface])

    def _add_synonyms(self, entity):
        aliases, variants = self.names.get(entity, ((), ()))
        for s in aliases:
            self.synonyms.setdefault(s, entity)
        self.synonyms |= dict.fromkeys(variants, entity)

    def _word_end(self, end: int) -> int:
        """End of the word at a position; the last character of the text is never taken in."""
        while end + 1 < len(self.text) and self.text[end].isalpha():
            end += 1
        return end

    def _accept(self, start: int, end: int, entity: str, by: str) -> None:
        self.covered[start:end] = b"\x01" * (end - start)
        self.found.append((start, end, entity, by))

    def _link(self, start: int, end: int, target: str, entity: str) -> None:
        if start is None or any(self.covered[start:end]):
            return
        surface = self.text[start:end]
        self.links[surface] = entity
        self._add_synonyms(entity)
        for tail in ("'s", "'"):
            if surface.endswith(tail) and not target.endswith(tail):
                end -= len(tail)
        if self.text.startswith(target, start):
            end = max(end, start + len(target))
        self._accept(start, self._word_end(end), entity, "HYPERLINK")

    def _occurrences(self, surface: str, entity: str) -> None:
        """All places of a text, left to right; behind a hit, taken or not, the search goes on at the end of its word."""
        at = self.text.find(surface) if surface else -1
        while at >= 0:
            after = at + 1
            if not (at and self.text[at - 1].isalpha()):
                after = self._word_end(at + len(surface))
                few = after - at - len(surface) <= min(3, len(surface))
                if few and not any(self.covered[at:after]) and self._fits(at, surface):
                    self._accept(at, after, entity, "NAME")
            at = self.text.find(surface, after)

    def _fits(self, start: int, surface: str) -> bool:
        """A single word at the start of a sentence, but for the first of the text, must not be a pronoun (without a tagger, all
        other words may be names)."""
        if start == 0 or " " in surface or not re.search(r"[.!?]\s+$|\n\s*$", self.text[max(0, start - 4) : start]):
            return True
        return surface.lower() not in PRONOUNS


def by_hyperlinks_and_names(articles: DataFrame, titles: DataFrame, redirects: DataFrame, names: DataFrame, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions by hyperlinks, bold titles and later occurrences of what was linked.

    names: (entity_id, name), types: (entity_id, types), aliases: (entity_id, aliases).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            some = lambda x: [] if x is None else x
            for r in f.itertuples():
                scan = ArticleScan(r.text, r.title, r.title_entity, some(r.title_synonyms), some(r.links), some(r.facts), bool(r.title_fine))
                rows += [(r.id, s, e, q, by, by) for s, e, q, by in sorted(scan.found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MENTIONS.split(", ")])

    return _prepared(articles, titles, redirects, names, types, aliases).mapInPandas(run, MENTIONS)


def bold_without_links(articles: DataFrame) -> DataFrame:
    """Articles whose bold title spans that overlap a hyperlink are taken out."""
    clear = F.filter("title_synonyms", lambda b: ~F.exists("hyperlinks", lambda h: (h["start"] < b["end"]) & (b["start"] < h["end"])))
    return articles.withColumn("title_synonyms", clear)


def by_popularity(spans: DataFrame, candidates: DataFrame, min_score: int = 0, uppercase_only: bool = False) -> DataFrame:
    """Recognised spans (article_id, start, end, text) linked to the most popular candidate of their text."""
    best = mappings.popular_entity(candidates, min_score).select(F.col("surface").alias("_s"), "entity_id")
    rows = spans.where(~tx.is_all_lower(F.col("text"))) if uppercase_only else spans
    return rows.join(best, F.col("text") == F.col("_s")).drop("_s")


def by_prior(spans: DataFrame, priors: DataFrame) -> DataFrame:
    """Recognised spans linked to the candidate of highest prior."""
    best = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("prior"), "entity_id"))
    top = priors.withColumn("_r", best).where("_r = 1").select(F.col("alias").alias("_a"), "entity_id", "prior")
    return spans.join(top, F.col("text") == F.col("_a")).drop("_a")


def capitalised_spans(docs: DataFrame) -> DataFrame:
    """A rule-based recogniser: whole runs of capitalised words. article_id, start, end, text."""
    pattern = r"\p{Lu}[\p{L}\p{N}'-]*+(?: \p{Lu}[\p{L}\p{N}'-]*+)*+"
    hits = docs.select(F.col("id").alias("article_id"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p")).where(F.size("m") > 0)
    hits = hits.withColumn("gap", F.transform("p", F.length)).withColumn("n", F.transform("m", lambda w, k: F.length(w) + F.get("gap", k))).drop("p")
    rows = tx.with_starts(hits, "n", "at").select("article_id", F.explode(F.arrays_zip("m", "gap", "at")).alias("t")).where("t.m is not null")
    start = F.col("t.at") + F.col("t.gap")
    return rows.select("article_id", start.alias("start"), (start + F.length("t.m")).alias("end"), F.col("t.m").alias("text"))
