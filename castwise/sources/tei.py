"""Plays encoded in TEI/XML, read on the executors into one nested row per file.

Files come in by ``binaryFile``; each is parsed by a streaming parser that knows lines and
fetches no external entity.  A file that can't be parsed gives a row with ``error`` and
stops nothing.  The tables are selections from the cached nested rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """path string, error string, play_id string, has_work_id boolean,
 title_en string, title_grc string, title_lat string, title_lat_abbr string, author string, author_en string, author_grc string, author_lat string, author_lat_abbr string, genre string,
 characters array<struct<char_id:string,name_grc:string,name_en:string,sex:string,nature:string,is_collective:boolean,is_chorus:boolean,is_speaker_explicit:boolean>>,
 relations array<struct<name:string,part:string,whole:string,declared:boolean>>,
 units array<struct<level:string,pos:long,xml_id:string,type:string,parent_id:string,parent_type:string>>,
 moves array<struct<pos:long,type:string,who:array<string>,corresp:array<string>,ana:array<string>,legacy:boolean,stage_pos:long,stage_line:long,source_line:long,bare:boolean,large_pos:long,large_id:string,large_type:string,middle_pos:long,middle_id:string>>,
 speeches array<struct<pos:long,who:array<string>,to_whom:array<string>,word_count:long,source_line:long,large_pos:long,large_id:string,large_type:string,middle_pos:long,middle_id:string>>"""

UNSPOKEN = {"note", "gap", "speaker", "stage"}
BLOCKS = {"l", "p", "ab"}


@dataclass
class Node:
    name: str
    at: dict[str, str]
    line: int
    inside: list = field(default_factory=list)  # texts and nodes in order

    def nodes(self):
        return (x for x in self.inside if isinstance(x, Node))

    def all(self, *names: str):
        """Nodes of these names below, in document order; however deep, without recursion."""
        todo = [*self.nodes()][::-1]
        while todo:
            x = todo.pop()
            if x.name in names:
                yield x
            todo.extend([*x.nodes()][::-1])

    def under(self, parent: str, *names: str):
        return [x for p in self.all(parent) for x in p.nodes() if x.name in names]

    def lead(self) -> str:
        """The text before the first child."""
        return (self.inside[0] if self.inside and isinstance(self.inside[0], str) else "").strip()

    def text(self, skip=frozenset()) -> str:
        todo, out = self.inside[::-1], []
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name not in skip:
                todo.extend(x.inside[::-1])
        return "".join(out)


def parse_xml(data) -> Node:
    """Bytes, or a file that is read in pieces.  Local names only; comments, instructions and external entities leave nothing behind."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    root = Node("", {}, 0)
    stack = [root]

    def start(name, attributes):
        node = Node(name.rpartition(":")[2], {k: v for k, v in attributes.items() if not k.startswith("xmlns")}, parser.CurrentLineNumber)
        stack[-1].inside.append(node)
        stack.append(node)

    def characters(text):
        own = stack[-1].inside
        if own and isinstance(own[-1], str):
            own[-1] += text
        else:
            own.append(text)

    parser.StartElementHandler, parser.CharacterDataHandler = start, characters
    parser.EndElementHandler = lambda name: stack.pop()
    parser.ExternalEntityRefHandler = lambda *_: 1
    if hasattr(data, "read"):
        parser.ParseFile(data)
    else:
        parser.Parse(data, True)
    return root


def refs(value: str | None) -> list[str]:
    return sorted({x.lstrip("#") for x in (value or "").split() if x.lstrip("#")})


def words(text: str) -> int:
    return sum(any(c.isalnum() for c in w) for w in text.split())


def spoken_words(speech: Node) -> int:
    own, todo = [], [*speech.nodes()][::-1]
    while todo:
        x = todo.pop()
        if x.name in BLOCKS:
            own.append(x)
        elif x.name not in UNSPOKEN:
            todo.extend([*x.nodes()][::-1])
    return sum(words(b.text(UNSPOKEN)) for b in own) if own else words(speech.text(UNSPOKEN))


def _named(nodes: list[Node]) -> dict[str, str]:
    """First non-empty text by language, '' for the first of all."""
    out: dict[str, str] = {}
    for x in nodes:
        if t := x.lead():
            out.setdefault("", t)
            out.setdefault(x.at.get("xml:lang", "?"), t)
    return out


def _latin(nodes: list[Node]) -> tuple[str, str]:
    for x in nodes:
        if x.at.get("xml:lang") == "lat":
            full, short = next(x.all("expan"), None), next(x.all("abbr"), None)
            return full.lead() if full else " ".join(x.text().split()), short.lead() if short else ""
    return "", ""


def work_id(root: Node) -> str:
    ids = [((x.at.get("type") or "").strip().lower(), x.text().strip()) for h in root.all("teiHeader") for x in h.all("idno")]
    for kind, value in ids:
        if kind in ("cts-urn", "cts", "urn") and (m := re.match(r"urn:cts:[^:]+:([^:.\s]+)\.([^:.\s]+)", value, re.I)):
            return f"{m[1]}.{m[2]}"
    for kind, value in ids:
        if kind == "tlg" and (m := re.search(r"(\d{1,4})\D+(\d{1,3})", value)):
            return f"tlg{int(m[1]):04d}.tlg{int(m[2]):03d}"
    return ""


def genre(root: Node) -> str:
    fits = lambda x: (x.at.get("scheme") or "").strip().lstrip("#") in ("", "genre")
    targets = [(x.at.get("target") or "").strip().lstrip("#") for x in root.under("textClass", "catRef") if fits(x)]
    codes = [x.lead() for x in root.under("textClass", "classCode") if fits(x)]
    return next((g for g in [*targets, *codes] if g), "")


def characters(root: Node) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for kind in ("person", "personGrp"):
        for x in root.under("listPerson", kind):
            if not (key := x.at.get("xml:id")):
                continue
            named = {n.at.get("xml:lang"): n.lead() for n in x.nodes() if n.name == "persName"}
            traits = {t.at.get("type"): t.at.get("key") for t in x.nodes() if t.name == "trait"}
            out[key] = {"char_id": key, "name_grc": named.get("grc", ""), "name_en": named.get("en", ""), "sex": traits.get("sex"), "nature": traits.get("nature"), "is_collective": kind == "personGrp", "is_chorus": False, "is_speaker_explicit": False}
    for item in root.under("castList", "castItem"):
        own = out.get((item.at.get("corresp") or "").lstrip("#"))
        if own is None:
            continue
        actor = next((x for x in item.nodes() if x.name == "actor"), None)
        marks = set(refs((actor.at.get("ana") if actor else None) or item.at.get("ana")))
        own["is_speaker_explicit"] |= "speaker" in marks
        own["is_collective"] |= "collective" in marks
        own["is_chorus"] |= bool(marks & {"chorus", "semichorus"})
    return out


def _milestone(x: Node, now: dict, unit: dict, out: dict) -> None:
    """A unit of the edition itself begins."""
    if x.at.get("source") or x.at.get("resp") or x.at.get("unit") not in ("large-seq", "middle-seq"):
        return
    now["pos"] += 1
    level, key = x.at["unit"].removesuffix("-seq"), x.at.get("xml:id")
    kind = x.at.get("type") if level == "large" else None
    parent = (None, None) if level == "large" else (unit["large_id"], unit["large_type"])
    unit.update({f"{level}_pos": now["pos"], f"{level}_id": key} | ({"large_type": kind} if level == "large" else {}))
    out["units"].append({"level": level, "pos": now["pos"], "xml_id": key, "type": kind, "parent_id": parent[0], "parent_type": parent[1]})


def _move(x: Node, here: tuple | None, now: dict, unit: dict, out: dict) -> None:
    """A move in a stage direction, or a bare one: neighbours without one make up a beat."""
    now["pos"] += 1
    if here is None and now["bare"] is None:
        now["stages"] += 1
        now["bare"] = (now["stages"], x.line)
    at, kinds = here or now["bare"], refs(x.at.get("subtype"))
    out["moves"].append({"pos": now["pos"], "type": (x.at.get("type") or "").strip(), "who": refs(x.at.get("who")), "corresp": refs(x.at.get("corresp")), "ana": sorted({*refs(x.at.get("ana")), *kinds}), "legacy": bool(kinds), "stage_pos": at[0], "stage_line": at[1], "source_line": x.line, "bare": here is None, **unit})


def body(root: Node) -> dict[str, list[dict]]:
    """Moves, speeches and unit starts with one running pos, in document order."""
    out: dict[str, list[dict]] = {"moves": [], "speeches": [], "units": []}
    unit = {"large_pos": None, "large_id": None, "large_type": None, "middle_pos": None, "middle_id": None}
    now = {"pos": 0, "stages": 0, "bare": None}

    # an open element: what is left of it, the stage direction it stands in, and whether it is within a speech
    todo = [[iter(b.inside), None, False] for b in list(root.all("body"))[:1]]
    while todo:
        frame = todo[-1]
        x = next(frame[0], None)
        if x is None:
            todo.pop()
        elif isinstance(x, Node):
            here, speaking = frame[1], frame[2]
            if x.name == "milestone":
                _milestone(x, now, unit, out)
            elif x.name == "stage":
                now["stages"] += 1
                now["bare"] = None
                here = (now["stages"], x.line)
                frame[1] = None  # a stage inside a stage ends the outer one's beat as well
            elif x.name == "move":
                _move(x, here, now, unit, out)
            elif x.name == "sp":
                if not speaking:
                    now["pos"] += 1
                    now["bare"] = None
                    out["speeches"].append({"pos": now["pos"], "who": refs(x.at.get("who")), "to_whom": refs(x.at.get("toWhom")), "word_count": spoken_words(x), "source_line": x.line, **unit})
                speaking = True
            todo.append([iter(x.inside), here, speaking])
    return out


def failed_row(path: str, error: Exception) -> dict:
    """One file's failure is its own row."""
    return {"path": path, "error": str(error), "play_id": Path(path).stem, "has_work_id": False}


def play(data, path: str) -> dict:
    """One row of SCHEMA."""
    root = parse_xml(data)
    titles, authors = root.under("titleStmt", "title"), root.under("titleStmt", "author")
    title, author, own = _named(titles), _named(authors), work_id(root)
    people = characters(root)
    related = []
    for x in root.under("listRelation", "relation"):
        name = (x.at.get("name") or x.at.get("type") or "").strip()
        related += [{"name": name, "part": a, "whole": b, "declared": a in people and b in people} for a in refs(x.at.get("active")) for b in refs(x.at.get("passive")) if name]
    (title_lat, title_abbr), (author_lat, author_abbr) = _latin(titles), _latin(authors)
    author_en = author.get("en") or author.get("", "")
    return {
        "path": path, "error": None, "play_id": own or Path(path).stem, "has_work_id": bool(own),
        "title_en": title.get("en") or title.get("", ""), "title_grc": title.get("grc", ""), "title_lat": title_lat, "title_lat_abbr": title_abbr,
        "author": author_en or author.get("grc", ""), "author_en": author_en, "author_grc": author.get("grc", ""), "author_lat": author_lat, "author_lat_abbr": author_abbr,
        "genre": genre(root), "characters": list(people.values()), "relations": related, **body(root),
    }


_COLUMNS = ["path", "error", "play_id", "has_work_id", "title_en", "title_grc", "title_lat", "title_lat_abbr", "author", "author_en", "author_grc", "author_lat", "author_lat_abbr", "genre", "characters", "relations", "units", "moves", "speeches"]


def read_plays(spark: SparkSession, *paths: str, pattern: str = "*.xml") -> DataFrame:
    """Nested rows of all files in the paths; each path is a file, or a folder filtered by pattern."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(play(bytes(data), path))
                except Exception as error:
                    rows.append(failed_row(path, error))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype(object).where(lambda x: x.notna(), None)

    spark_paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    is_file = lambda p: not any(c in p for c in "*?[{") and (at := spark_paths(p)).getFileSystem(conf).getFileStatus(at).isFile()
    files = [p for p in paths if is_file(p)]  # whatever their extension
    folders = [p for p in paths if p not in files]
    raw = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders)] if folders else []
    raw += [spark.read.format("binaryFile").load(files)] if files else []
    both = raw[0] if len(raw) == 1 else raw[0].unionByName(raw[1])
    return both.select("path", "content").dropDuplicates(["path"]).mapInPandas(run, SCHEMA)


def tables(plays: DataFrame) -> dict[str, DataFrame]:
    """plays, characters, relations, units, moves, speeches, part_of by play_id."""
    good = plays.where("error IS NULL")
    many = lambda c: good.select("play_id", F.explode(c).alias("x")).select("play_id", "x.*")
    out = {c: many(c) for c in ("characters", "relations", "units", "moves", "speeches")}
    heard = out["speeches"].select("play_id", F.explode("who").alias("char_id")).distinct().withColumn("_heard", F.lit(True))
    out["characters"] = out["characters"].join(heard, ["play_id", "char_id"], "left").withColumn("is_mute", F.col("_heard").isNull()).drop("_heard")
    related = good.select("play_id", F.posexplode("relations").alias("n", "x")).select("play_id", "n", "x.*")
    out["part_of"] = related.where("declared AND name = 'partOf'").select("play_id", "part", "whole", "n")
    out["plays"] = good.drop("characters", "relations", "units", "moves", "speeches", "error")
    out["failed"] = plays.where("error IS NOT NULL").select("path", "error")
    return out
