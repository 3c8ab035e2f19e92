"""What a store of projects and cases has to offer, and the vault as one."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.model import Context
from tracklight.operators import capture, catalogs, tree
from tracklight.sources import projects as project_notes
from tracklight.sources import vault


@runtime_checkable
class Source(Protocol):
    """Operators only know DataFrames; a store reads them and writes what has changed."""

    def projects(self) -> DataFrame: ...

    def cases(self) -> DataFrame: ...

    def context_for(self, cases: DataFrame, ctx: Context) -> tuple[DataFrame, Context]: ...

    def save(self, cases: DataFrame, ctx: Context, projects: DataFrame | None = None) -> int: ...


class Vault:
    """A folder of notes that driver and executors reach."""

    def __init__(self, spark: SparkSession, folder: str, base: str = "") -> None:
        self.spark, self.folder, self.base = spark, folder, base

    def files(self) -> DataFrame:
        return vault.read_files(self.spark, self.folder)

    def projects(self) -> DataFrame:
        """Projects (PROJECT_SCHEMA) in the order of their titles."""
        found = project_notes.parse_projects(project_notes.discover(self.files(), self.base))
        return found.orderBy(F.collate("title", "UNICODE"), "file_path")

    def cases(self) -> DataFrame:
        """The healed forest of the notes' cases and of those that old projects hold themselves."""
        files = self.files()
        held = project_notes.parse_embedded(project_notes.discover(files, self.base))
        return vault.assemble(vault.parse_notes(files)).unionByName(held)

    def context_for(self, cases: DataFrame, ctx: Context) -> tuple[DataFrame, Context]:
        """(cases, context) in which each case's status is understood by its own project's settings."""
        default = self.spark.createDataFrame([(i, *s) for i, s in enumerate(ctx.statuses)], "ord int, id string, label string, complete boolean")
        resolved = catalogs.resolve(project_notes.catalog(self.projects()), default, catalogs.in_use(cases))
        return catalogs.attach(cases, resolved), ctx.but(per_project=True)

    def save(self, cases: DataFrame, ctx: Context, projects: DataFrame | None = None) -> int:
        """Writes the notes of cases (with all their siblings and children, as the notes list them) and of projects; the number of files."""
        notes = vault.render_notes(cases, ctx.terminal)
        if projects is not None:
            notes = notes.union(project_notes.render_projects(projects, cases, ctx))
        return vault.write_notes(notes, self.folder)

    # Changes: each gives the new cases, which save() writes.

    insert = staticmethod(tree.insert)
    move = staticmethod(tree.move)
    reorder = staticmethod(tree.reorder)
    delete = staticmethod(tree.delete)
    duplicate = staticmethod(tree.clone)
    update = staticmethod(capture.apply_patches)
    archive = staticmethod(capture.archive)
