"""The reading service: every query and state change of a workspace, as DataFrames over its tables.

Tables lie under the workspace's root: ``blocks``, ``sections``, ``files``, ``annotations``, ``plans``,
``plan_sections``, ``plan_completed`` and the index.  State tables are append-only logs whose latest row counts; of
blocks and sections a document has those that were saved last.
"""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import snippet
from quire.operators import assets, concepts, graph, plans, search
from quire.operators.index import SectionIndex
from quire.operators.validation import InvalidIdError, require_valid

_SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
_STATE = {
    "annotations": "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string, model string, created_at string, at long",
    "plans": "plan_id string, doc_id string, daily_sections int, at long",
    "plan_sections": "plan_id string, pos long, section_id string, at long",
    "plan_completed": "plan_id string, seq long, section_id string, at long",
    "files": "doc_id string, path string",
}
_SECTIONS = "doc_id string, section_id string, ord long, title string, level int, heading_path array<string>, page_start int, page_end int, text string, block_ids array<string>, prev_id string, next_id string"
_BLOCKS = "doc_id string, ord long, id string, type string, text string, level int, page_idx int, doc_title string, asset_path string"


class NotFoundError(LookupError):
    """A document, section, concept or plan that the workspace doesn't have."""


class PlanExistsError(ValueError):
    """A plan of that name is there already."""


def checked_id(value: str, what: str) -> str:
    if not _SLUG.fullmatch(value):
        raise InvalidIdError(f"{what} {value!r} is no slug")
    return value


class ReadingService:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.index = SectionIndex(spark, f"{self.root}/index")

    # tables

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("at", F.lit(time.time_ns())).select(*(c.split(" ")[0] for c in _STATE[name].split(", "))).write.mode("append").parquet(f"{self.root}/{name}")

    def _latest(self, name: str, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("at"))
        return self._table(name, _STATE[name]).withColumn("_nr", F.rank().over(order)).where("_nr = 1").drop("_nr", "at")

    def _saved_last(self, name: str, schema: str) -> DataFrame:
        """The rows that each document's last batch has."""
        log = self._table(name, f"{schema}, at long").withColumn("at", F.coalesce("at", F.lit(0)))
        return log.join(log.groupBy("doc_id").agg(F.max("at").alias("at")), ["doc_id", "at"], "left_semi").select(*(c.split(" ")[0] for c in schema.split(", ")))

    def _save(self, name: str, rows: DataFrame, schema: str) -> None:
        have = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))]
        rows.select(*have, F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(f"{self.root}/{name}")

    def sections(self) -> DataFrame:
        return self._saved_last("sections", _SECTIONS)

    def blocks(self) -> DataFrame:
        return self._saved_last("blocks", _BLOCKS)

    def annotations(self) -> DataFrame:
        return self._latest("annotations", "doc_id", "section_id")

    def save_blocks(self, blocks: DataFrame) -> None:
        """Stores all blocks of the documents in ``blocks``, instead of those that they had."""
        self._save("blocks", blocks, _BLOCKS)

    def save_sections(self, sections: DataFrame) -> None:
        """Stores all sections of the documents in ``sections``, instead of those that they had."""
        self._save("sections", require_valid(sections), _SECTIONS)

    def build_index(self, doc_ids: list[str] | None = None) -> str:
        """Indexes the documents anew, all of them without ``doc_ids``, in one job for all."""
        sections, annotations = self.sections(), self.annotations()
        if doc_ids is not None:
            sections = sections.where(F.col("doc_id").isin(doc_ids))
            annotations = annotations.where(F.col("doc_id").isin(doc_ids))
        titles = self.blocks().groupBy("doc_id").agg(F.max("doc_title").alias("title"))
        return self.index.build(sections, annotations, titles)

    # queries

    def _one(self, doc_id: str, section_id: str) -> DataFrame:
        checked_id(doc_id, "document")
        own = self.sections().where((F.col("doc_id") == doc_id) & (F.col("section_id") == section_id))
        if own.isEmpty():
            raise NotFoundError(f"no section {section_id!r} in {doc_id!r}")
        return own

    def _document(self, doc_id: str) -> DataFrame:
        own = self.sections().where(F.col("doc_id") == checked_id(doc_id, "document"))
        if own.isEmpty():
            raise NotFoundError(f"no document {doc_id!r}")
        return own

    def search(self, query: str, doc_id: str | None = None, limit: int = 10) -> DataFrame:
        """Indexed documents by BM25, others by term frequency, best first (doc_id, section_id, title, snippet, score)."""
        found = search.checked_terms(query, limit)
        sections = self.sections() if doc_id is None else self._document(doc_id)
        known = self.index.catalog().select("doc_id")
        ranked = self.index.search(query, limit, None if doc_id is None else [doc_id])
        scanned = search.term_frequency(sections.join(known, "doc_id", "left_anti"), query).orderBy(F.desc("score"), "doc_id", "section_id").limit(limit)
        hits = ranked.unionByName(scanned).orderBy(F.desc("score"), "doc_id", "section_id").limit(limit)
        return hits.select("doc_id", "section_id", "title", snippet(F.col("text"), found).alias("snippet"), "score")

    def get_section(self, doc_id: str, section_id: str, include_assets: bool = True) -> DataFrame:
        own = self._one(doc_id, section_id)
        if not include_assets:
            return own
        found = assets.section_assets(own, self.blocks().where(F.col("doc_id") == doc_id), self._table("files", _STATE["files"]))
        notes = assets.asset_notes(own, found).select("section_id", "note")
        listed = found.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "type", "caption", "path"))).alias("assets"))
        return own.join(listed, "section_id", "left").join(notes, "section_id", "left")

    def get_outline(self, doc_id: str) -> DataFrame:
        return graph.outline(self._document(doc_id)).orderBy("ord")

    def get_related(self, doc_id: str, section_id: str) -> DataFrame:
        self._one(doc_id, section_id)
        return graph.related(self._document(doc_id)).where(F.col("section_id") == section_id)

    def get_context(self, doc_id: str, section_id: str, include_assets: bool = True) -> dict[str, DataFrame]:
        """The section, what is around it, its concepts from the index, and its summary as it is now."""
        summary = self.annotations().where((F.col("doc_id") == doc_id) & (F.col("section_id") == section_id)).select("summary")
        return {
            "section": self.get_section(doc_id, section_id, include_assets), "related": self.get_related(doc_id, section_id),
            "concepts": self.index.section_concepts(doc_id, section_id), "summary": summary,
        }

    def get_concept(self, slug: str, include_annotations: bool = False) -> dict[str, DataFrame]:
        """The concept's node, with how many mentions have a summary, and its mentions; summaries only if asked for."""
        checked_id(slug, "concept")
        mentions = self.index.concept_mentions().where(F.col("slug") == slug)
        node = self.index.concept_nodes().where(F.col("slug") == slug)
        if node.isEmpty():
            raise NotFoundError(f"no concept {slug!r}")
        node = node.crossJoin(mentions.agg(F.count_if(F.col("summary") != "").alias("annotated_mention_count")))
        return {"node": node, "mentions": mentions.withColumn("summary", F.when(F.lit(include_annotations), F.col("summary")).otherwise(""))}

    def list_documents(self) -> DataFrame:
        titles = self.blocks().groupBy("doc_id").agg(F.max("doc_title").alias("_title"))
        counts = self.sections().groupBy("doc_id").agg(F.count(F.lit(1)).alias("section_count"))
        return counts.join(titles, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("_title", F.lit("")), "doc_id").alias("title"), "section_count").orderBy("doc_id")

    # state

    def annotate_section(self, doc_id: str, section_id: str, concepts_: list[dict] | None = None, summary: str = "", model: str | None = None) -> DataFrame:
        """Stores a reviewer's annotation; the next index build takes it in.  No list is no opinion, an empty one prunes."""
        self._one(doc_id, section_id)
        listed = None if concepts_ is None else [(c.get("slug", ""), c.get("title", ""), c.get("gloss", "")) for c in concepts_]
        schema = _STATE["annotations"].removesuffix(", at long")
        row = self.spark.createDataFrame([(doc_id, section_id, listed, summary, model, datetime.now(UTC).isoformat())], schema)
        clean = concepts.resolve_annotations(row).select("concepts", "summary").first()
        row = self.spark.createDataFrame([(doc_id, section_id, None if listed is None else [tuple(c) for c in clean["concepts"]], clean["summary"], model, datetime.now(UTC).isoformat())], schema)
        self._log("annotations", row)
        return row

    def create_plan(self, doc_id: str, plan_id: str | None = None, daily_sections: int = 1, overwrite: bool = False) -> DataFrame:
        plan_id = checked_id(plan_id or f"{doc_id}-plan", "plan")
        if not overwrite and not self._latest("plans", "plan_id").where(F.col("plan_id") == plan_id).isEmpty():
            raise PlanExistsError(f"plan {plan_id!r} exists")
        plan, own = plans.create_plan(self._document(doc_id), plan_id, doc_id, daily_sections)
        self._log("plan_sections", own)
        self._log("plan_completed", self.spark.createDataFrame([(plan_id, -1, None)], "plan_id string, seq long, section_id string"))
        self._log("plans", plan)
        return plan

    def _plan(self, plan_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        tables = (self._latest("plans", "plan_id"), self._latest("plan_sections", "plan_id"), self._completed())
        if plan_id is None:
            return tables
        checked_id(plan_id, "plan")
        own = tuple(t.where(F.col("plan_id") == plan_id) for t in tables)
        if own[0].isEmpty():
            raise NotFoundError(f"no plan {plan_id!r}")
        return own

    def _completed(self) -> DataFrame:
        """Marks since a plan was last made (its own mark has seq -1)."""
        log = self._table("plan_completed", _STATE["plan_completed"])
        made = log.where("seq = -1").groupBy("plan_id").agg(F.max("at").alias("_made"))
        return log.join(made, "plan_id").where("at > _made AND seq >= 0").select("plan_id", "seq", "section_id")

    def completed(self, plan_id: str) -> DataFrame:
        """(section_id) of what a plan has marked as read."""
        return self._plan(plan_id)[2].select("section_id")

    def get_next_section(self, plan_id: str) -> DataFrame:
        """The next batch's sections; nothing is marked."""
        batch = plans.next_batch(*self._plan(plan_id)).select("doc_id", "section_id", "pos")
        gone = batch.join(self.sections().select("doc_id", "section_id"), ["doc_id", "section_id"], "left_anti").orderBy("pos").first()
        if gone:
            raise NotFoundError(f"plan {plan_id!r} has section {gone['section_id']!r}, which {gone['doc_id']!r} has no more")
        return self.sections().join(batch, ["doc_id", "section_id"]).orderBy("pos")

    def mark_read(self, plan_id: str, section_id: str | None = None) -> DataFrame:
        """Marks a section, the next unread one without ``section_id``; returns the plan's progress."""
        plan, own, completed = self._plan(plan_id)
        known = {r["section_id"] for r in own.where(F.col("section_id") == section_id).limit(1).collect()} if section_id else set()
        if section_id and section_id not in known:
            raise plans.UnknownSectionError(f"plan {plan_id!r} has no section {section_id!r}")
        if section_id is None and plans.unread(own, completed).isEmpty():
            raise plans.PlanCompleteError(f"plan {plan_id!r} is complete")
        marks = self.spark.createDataFrame([(plan_id, section_id)], "plan_id string, section_id string")
        fresh = plans.mark_read(own, completed, marks).join(completed.select("plan_id", "seq"), ["plan_id", "seq"], "left_anti")
        self._log("plan_completed", self.spark.createDataFrame(fresh.select("plan_id", "seq", "section_id").collect(), "plan_id string, seq long, section_id string"))
        return plans.progress(*self._plan(plan_id))

    def list_plans(self) -> DataFrame:
        return plans.progress(*self._plan()).orderBy("plan_id")
