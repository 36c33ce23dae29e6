"""Differences of XML documents, node by node.

Documents are compared by hash first, so contents of equal ones are not dealt out. The others become nodes with
a hash of all below them; only nodes whose hash differs are compared, and of a part that one side lacks its
top node is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def xml_nodes(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, path, parent, value, subtree) for every element; names without namespace, equal siblings numbered.

    ``value`` is the element's own text and attributes, ``subtree`` a hash of it and of all below. A text that is
    no XML is one node with the path ``?`` and the text as its value.
    """

    # Functions made here travel with their code: executors need not have this package.
    def parsed(text: str) -> list[tuple[str, str, str, str]]:
        import hashlib
        from xml.etree import ElementTree

        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return [("?", "", text, text)]
        local = lambda name: name.rpartition("}")[2]
        rows, waiting = [], [(root, f"/{local(root.tag)}", "")]
        while waiting:  # parents before their children
            node, path, parent = waiting.pop()
            named = sorted((local(k), v.strip()) for k, v in node.attrib.items())
            parts = [(node.text or "").strip(), *((child.tail or "").strip() for child in node)]
            value = " ".join([p for p in parts if p] + [f"@{k}={v}" for k, v in named])
            rows.append([path, parent, value, hashlib.md5(value.encode())])
            seen: dict[str, int] = {}
            for child in node:
                name = local(child.tag)
                seen[name] = seen.get(name, 0) + 1
                waiting.append((child, f"{path}/{name}[{seen[name]}]", path))
        at = {row[0]: row for row in rows}
        digests = {}
        for path, parent, _, digest in reversed(rows):
            digests[path] = digest.hexdigest()
            if parent:
                at[parent][3].update(f"{path}\n{digests[path]}\n".encode())
        return [(path, parent, value, digests[path]) for path, parent, value, _ in rows]

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            found = [(k, *node) for k, text in zip(rows[key], rows[xml]) for node in parsed(text)]
            yield pd.DataFrame(found, columns=[key, "path", "parent", "value", "subtree"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.where(F.col(xml).isNotNull()).select(key, xml)
    return texts.mapInPandas(nodes, f"`{key}` {kind}, path string, parent string, value string, subtree string")


def xml_differences(left: DataFrame, right: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, path, change, left_value, right_value): ``changed`` values, and nodes ``only_left`` or ``only_right``.

    A document that one side lacks is one row with the path ``/``. Keys must be unique; rows with a null
    key or text are no documents.
    """
    brief = lambda df, name: df.where(F.col(key).isNotNull() & F.col(xml).isNotNull()).select(
        key, F.sha2(F.col(xml).cast("binary"), 256).alias(name)
    )
    met = brief(left, "_left").join(brief(right, "_right"), key, "full")
    lone = met.where("_left is null or _right is null").select(
        key,
        F.lit("/").alias("path"),
        F.when(F.col("_right").isNull(), "only_left").otherwise("only_right").alias("change"),
        F.lit(None).cast("string").alias("left_value"),
        F.lit(None).cast("string").alias("right_value"),
    )
    differ = met.where("_left <> _right").select(key)

    def opened(df: DataFrame, side: str) -> DataFrame:
        found = xml_nodes(df.join(differ, key, "left_semi"), key, xml)
        return found.withColumnsRenamed({"value": f"{side}_value", "subtree": f"{side}_subtree", "parent": f"{side}_parent"})

    both = opened(left, "left").join(opened(right, "right"), [key, "path"], "full")
    both = both.where(~F.col("left_subtree").eqNullSafe(F.col("right_subtree")))
    change = F.when(F.col("right_subtree").isNull(), "only_left").when(F.col("left_subtree").isNull(), "only_right")
    found = both.withColumn("change", change.when(F.col("left_value") != F.col("right_value"), "changed"))
    found = found.where("change is not null").withColumn("parent", F.coalesce("left_parent", "right_parent"))
    above = found.where("change <> 'changed'").select(key, F.col("path").alias("parent"))
    tops = found.join(above, [key, "parent"], "left_anti")
    return tops.select(key, "path", "change", "left_value", "right_value").unionByName(lone)
