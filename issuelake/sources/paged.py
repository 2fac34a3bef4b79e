"""A page-by-page source over any paged listing, as a Spark data source; the offline form reads Parquet pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedPartition(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


class PagedIssues(DataSource):
    """Options: path (a folder of JSON pages, <owner>__<name>/<page>.json), repos (comma-separated), max_pages, per_page."""

    @classmethod
    def name(cls) -> str:
        return "paged_issues"

    def schema(self) -> str:
        return "repo string, page int, number int, title string, state string, is_pull_request boolean"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    """One partition a repository; a listing ends at a short page or at max_pages."""

    def __init__(self, options):
        self.path = options["path"]
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.most = int(options.get("max_pages", 10))
        self.per = int(options.get("per_page", 100))

    def partitions(self) -> list[PagedPartition]:
        return [PagedPartition(r) for r in self.repos]

    def read(self, partition: PagedPartition) -> Iterator[tuple]:
        import json
        from pathlib import Path

        for page in range(1, self.most + 1):
            file = Path(self.path, partition.repo.replace("/", "__"), f"{page}.json")
            if not file.exists():
                return
            items = json.loads(file.read_text())
            for x in items:
                pull = x.get("pull_request") is not None or "/pull/" in (x.get("html_url") or "")
                yield partition.repo, page, x.get("number"), x.get("title"), x.get("state"), pull
            if len(items) < self.per:
                return
