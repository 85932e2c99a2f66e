"""A source tree as a data source that lists every file, empty ones too, and the rules of its ignore files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

# The largest source file, folders that are not searched, and ignore files, the first of which that says anything of a path counts.
MAX_FILE_BYTES = 1024 * 1024
SKIP_DIRS = ["node_modules", ".venv", "venv", "site-packages", "dist", "build", "__pycache__", ".git"]
IGNORE_FILES = [".ignore", ".gitignore"]
TREE = "rel string, bytes long, content binary"
BATCH_BYTES = 1 << 23


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if urlparse(root).scheme else (fs.LocalFileSystem(), root)


def _searched(name: str) -> bool:
    return not name.startswith(".") and name not in SKIP_DIRS


class Folder(InputPartition):
    """Folders of a tree, below the root, and whether to go below them."""

    def __init__(self, paths: list[str], deep: bool):
        super().__init__(paths)
        self.paths, self.deep = paths, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most = root.rstrip("/"), most

    def _entries(self, store: fs.FileSystem, base: str, rel: str) -> Iterator[tuple[str, fs.FileInfo]]:
        for info in store.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"), recursive=False, allow_not_found=not rel)):
            yield f"{rel}/{info.base_name}".lstrip("/"), info

    def partitions(self) -> list[Folder]:
        """Folders are opened level by level until there are enough of them; what lies in those above is a part of its own."""
        store, base = _open(self.root)
        above, level = [], [""]
        while level and len(level) < self.most:
            below = [rel for folder in level for rel, info in self._entries(store, base, folder) if info.type == fs.FileType.Directory and _searched(info.base_name)]
            above += level
            level = below
        return [Folder([x], False) for x in above] + [Folder([x], True) for x in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, base = _open(self.root)
        rows, held, todo = [], 0, list(partition.paths)
        schema = pa.schema([("rel", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
        while todo:
            for rel, info in self._entries(store, base, todo.pop()):
                if info.type == fs.FileType.Directory:
                    if partition.deep and _searched(info.base_name):
                        todo.append(rel)
                elif info.type == fs.FileType.File and (not info.base_name.startswith(".") or info.base_name in IGNORE_FILES):
                    content = None
                    if info.size <= MAX_FILE_BYTES:
                        with store.open_input_stream(info.path) as f:
                            content = f.read()
                    rows.append((rel, info.size, content))
                    held += len(content or b"")
                    if held > BATCH_BYTES or len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("parts", n).load(root): rel, bytes and content of all files but hidden ones and those of folders that are not searched; content is null beyond MAX_FILE_BYTES."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("parts", 64)))


def all_files(spark: SparkSession, root: str, parts: int = 64) -> DataFrame:
    """(rel, bytes, content) of the files under root, empty ones and ignore files too. Folders are listed and read in the tasks; the driver lists the upper ones, until there are `parts`."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("parts", parts).load(root)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob of an ignore file, on paths below the file's folder. With a slash before its end it is bound to that folder."""
    bound = "/" in glob.rstrip("/")[:-1] or glob.startswith("/")
    glob = glob.strip("/") if bound else glob.rstrip("/")
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out.append(".+")
            break
        if c == "*":
            out.append("[^/]*")
            while glob.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            body = ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{body}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append("\\" + glob[i] if not glob[i].isalnum() else glob[i])
        else:
            out.append(c if c.isalnum() or c in "_-/ " or ord(c) > 127 else "\\" + c)
        i += 1
    return ("" if bound else "(?:.*/)?") + "".join(out)


@F.pandas_udf(StringType())
def _patterns(globs: pd.Series) -> pd.Series:
    return globs.map(glob_pattern)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, rank, line, negated, only_folders, pattern): the rules of the ignore files among files (rel, text). rank is the place of the file's name in IGNORE_FILES.

    Blank lines and those that begin with # are none; ! negates; a slash at the end means folders only; blanks at the end go unless a backslash keeps them.
    """
    name, folder = F.substring_index("rel", "/", -1), F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise("")
    rank = F.array_position(F.array(*map(F.lit, IGNORE_FILES)), name) - 1
    lines = files.where(name.isin(IGNORE_FILES)).select(folder.alias("folder"), rank.cast("int").alias("rank"), F.posexplode(F.split(F.regexp_replace("text", "\\r\\n", "\\n"), "\\n")).alias("line", "raw"))
    text = F.regexp_replace("raw", r"(?<!\\)[ \t]+$", "")
    lines = lines.withColumn("text", text).where("text <> '' and not startswith(text, '#')")
    negated = F.col("text").startswith("!")
    rules = lines.withColumn("negated", negated).withColumn("glob", F.when(negated, F.expr("substr(text, 2)")).otherwise(F.col("text"))).where(F.col("glob").rlike("[^/]"))
    return rules.select("folder", "rank", "line", "negated", F.col("glob").endswith("/").alias("only_folders"), _patterns("glob").alias("pattern"))


def _parts(path: Column) -> Column:
    """Every path above a path, from the top, and itself."""
    split = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(split)), lambda k: F.array_join(F.slice(split, 1, k), "/"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (rel, ...) that rules leave in the tree.

    Of the rules that match a path the last one of the deepest folder counts, of the first rank that has any. A file is out if it or any folder above it is: what lies in an excluded folder can't be brought
    back. Each path is decided once, however many files lie below it. Rules meet the paths below their folder by an equi-join.
    """
    above = files.select("rel", F.explode(_parts(F.col("rel"))).alias("path"))
    paths = above.groupBy("path").agg(F.min(F.col("path") == F.col("rel")).alias("file"))
    upper = F.concat(F.array(F.lit("")), F.slice(_parts(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1))
    met = paths.select("path", "file", F.posexplode(upper).alias("depth", "folder")).join(rules, "folder")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substr(path, length(folder) + 2)"))
    hit = met.where((~F.col("only_folders") | ~F.col("file")) & F.regexp_like(rest, F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))))
    decided = hit.groupBy("path").agg(F.max(F.struct((-F.col("rank")).alias("r"), "depth", "line", "negated")).alias("x")).where(~F.col("x.negated")).select("path")
    out = above.join(decided, "path", "left_semi").select("rel").distinct()
    return files.join(out, "rel", "left_anti")
