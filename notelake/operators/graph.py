"""The collection as a property graph and as RDF: node, edge and triple tables, and files of them."""

from __future__ import annotations

from functools import reduce
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..model import LINK_TYPES, LIST_TYPES, FieldType
from ..session import written
from . import relations

#: Letters that are spelled out in ASCII names.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}


def ascii_slug(c: Column) -> Column:
    """Umlauts spelled out, other letters beyond ASCII dropped, the rest that is no letter, digit or _ made _."""
    for letter, plain in SPELLED.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), "[^A-Za-z0-9_]", "_")


def slug(text: str) -> str:
    for letter, plain in SPELLED.items():
        text = text.replace(letter, plain)
    return "".join(ch if ch.isascii() and ch.isalnum() or ch == "_" else "_" for ch in text if ch.isascii())


def identifier(text: str) -> str:
    """A slug that is never empty and doesn't begin with a digit."""
    plain = slug(text)
    return "_field" if not plain else f"_{plain}" if plain[0].isdigit() else plain


def node_id(name: Column, type_name: Column) -> Column:
    return F.concat(name, F.lit("|"), type_name)


#: The XML Schema type of each field type's literals.
XSD = {FieldType.STRING: "string", FieldType.INTEGER: "integer", FieldType.NUMBER: "double", FieldType.BOOLEAN: "boolean", FieldType.DATE: "date", FieldType.DATETIME: "dateTime", FieldType.LIST_INTEGERS: "integer", FieldType.LIST_NUMBERS: "double"}
RDF, RDFS, OWL, XS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"


class Graph:
    def __init__(self, owner) -> None:
        self.owner = owner

    # -- property graph ----------------------------------------------------------------------------------------

    def nodes(self, implicit: bool = True) -> DataFrame:
        """(id, type, name, attrs): a node for each record, attrs the fields that are set and hold no links, as JSON.

        implicit: also the targets that no record is behind, without type and attrs.
        """
        parts = []
        for name, ts in self.owner.schema.types.items():
            own = [F.col(f"`{f.name}`").alias(f.name) for f in ts.fields if f.effective_type not in LINK_TYPES and f.name in self.owner.tables[name].columns]
            attrs = F.to_json(F.struct(*own)) if own else F.lit("{}")
            parts.append(self.owner.tables[name].select(node_id(F.col("_record"), F.lit(name)).alias("id"), F.lit(name).alias("type"), F.col("_record").alias("name"), attrs.alias("attrs")))
        known = reduce(DataFrame.unionByName, parts)
        if not implicit:
            return known
        none = F.lit(None).cast("string")
        more = self.edges().select(F.col("target").alias("id")).distinct().join(known, "id", "left_anti")
        return known.unionByName(more.select("id", none.alias("type"), F.split("id", r"\|")[0].alias("name"), none.alias("attrs")))

    def edges(self, multi: bool = False) -> DataFrame:
        """(source, target, field): by node ids; the target of an ambiguous field is a bare name.

        multi keeps an edge for each field; without it a pair of nodes has one edge, that of its last field.
        """
        known = self.owner.schema.types
        ranks = [(n, f.name, i, f.link_target) for n, ts in known.items() for i, f in enumerate(ts.fields) if f.effective_type in LINK_TYPES]
        fields = self.owner.spark.createDataFrame(ranks, "src_type string, field string, rank int, link_target string")
        e = relations.edges(self.owner.tables, self.owner.schema).join(fields, ["src_type", "field"])
        each = e.select(node_id(F.col("src"), F.col("src_type")).alias("source"), F.when(F.col("link_target").isNull(), F.col("name")).otherwise(node_id(F.col("name"), F.col("link_target"))).alias("target"), "field", "rank")
        if multi:
            return each.select("source", "target", "field").distinct()
        return each.groupBy("source", "target").agg(F.max_by("field", "rank").alias("field"))

    def undirected(self) -> DataFrame:
        """(a, b), a <= b: edges without direction, reciprocal ones once."""
        return self.edges().select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    def flattened(self) -> DataFrame:
        """nodes() with lists joined and everything else as text: (id, type, attrs as a map of text)."""
        parts = []
        for name, ts in self.owner.schema.types.items():
            own = [f for f in ts.fields if f.effective_type not in LINK_TYPES and f.name in self.owner.tables[name].columns]
            value = lambda f: F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string")), ", ", "None") if f.effective_type in LIST_TYPES else F.col(f"`{f.name}`").cast("string")
            entries = F.array(*[F.struct(F.lit(f.name).alias("k"), value(f).alias("v")) for f in own]) if own else F.array().cast("array<struct<k:string,v:string>>")
            parts.append(self.owner.tables[name].select(node_id(F.col("_record"), F.lit(name)).alias("id"), F.lit(name).alias("type"), F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull())).alias("attrs")))
        return reduce(DataFrame.unionByName, parts)

    def reach(self, seeds: DataFrame, depth: int | None = None) -> DataFrame:
        """(id, steps): nodes that seeds (id) reach over edges, with the fewest steps; at most depth, if given. A step writes its new nodes only."""
        edges = written(self.edges().select("source", "target"), "edges")
        front = written(seeds.select("id").distinct().withColumn("steps", F.lit(0)), "front")
        seen, step = front, 0
        while depth is None or step < depth:
            step += 1
            found = front.join(edges, front["id"] == edges["source"]).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti")
            front = written(found.withColumn("steps", F.lit(step)), "front")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen

    def cypher_tables(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Node tables by type and relation tables (source, target) by name: only fields with a known target, only edges with both ends."""
        tables = self.owner.tables
        nodes = {identifier(n): self.owner.db.table(n) for n in self.owner.schema.types}
        names = self.relation_names()
        out = {}
        for (type_name, field), name in names.items():
            target = self.owner.schema.types[type_name][field].link_target
            e = relations.edge_table(tables[type_name], self.owner.schema.types[type_name][field])
            out[name] = e.join(tables[target].select(F.col("_record").alias("target")), "target", "left_semi").select("source", "target")
        return nodes, out

    def relation_names(self) -> dict[tuple[str, str], str]:
        """A name for each link field with a known target: the field's, or Type__field if several types or a type use it."""
        types = self.owner.schema.types
        fields = [(n, f.name) for n, ts in types.items() for f in ts.fields if f.effective_type in LINK_TYPES and f.link_target in types]
        short = [identifier(f) for _, f in fields]
        taken = {identifier(n) for n in types}
        return {(n, f): f"{identifier(n)}__{s}" if short.count(s) > 1 or s in taken else s for (n, f), s in zip(fields, short)}

    def names(self) -> dict[str, dict]:
        """By type: the node name, and the names of its properties and relations."""
        rel = self.relation_names()
        return {n: {"node": identifier(n), "properties": {f.name: identifier(f.name) for f in ts.fields if f.effective_type not in LINK_TYPES}, "relationships": {f: r for (t, f), r in rel.items() if t == n}} for n, ts in self.owner.schema.types.items()}

    def rdf_names(self, base_uri: str = "http://collection/") -> dict[str, dict]:
        """By type: the URI of its class, and of its properties and (with a known target) relations."""
        uri = lambda x: base_uri + slug(x)
        types = self.owner.schema.types
        return {n: {"class": uri(n), "properties": {f.name: uri(f.name) for f in ts.fields if f.effective_type not in LINK_TYPES}, "relationships": {f.name: uri(f.name) for f in ts.links() if f.link_target in types}} for n, ts in types.items()}

    # -- RDF ---------------------------------------------------------------------------------------------------

    def triples(self, base_uri: str = "http://collection/") -> DataFrame:
        """(s, p, o, o_kind, datatype), distinct: classes, properties, inverses of pairs, individuals, links and literals."""
        spark, types = self.owner.spark, self.owner.schema.types
        uri = lambda s: base_uri + slug(s)
        facts: set[tuple] = set()
        for name, ts in types.items():
            facts |= {(uri(name), RDF + "type", OWL + "Class", "uri", None), (uri(name), RDFS + "label", name, "literal", XS + "string")}
            for f in ts.fields:
                kind = "ObjectProperty" if f.effective_type in LINK_TYPES else "DatatypeProperty"
                facts |= {(uri(f.name), RDF + "type", OWL + kind, "uri", None), (uri(f.name), RDFS + "label", f.name, "literal", XS + "string")}
        for a, b in self.owner.pairs:
            one, two = a.split(".", 1)[1], b.split(".", 1)[1]
            facts |= {(uri(one), OWL + "inverseOf", uri(two), "uri", None), (uri(two), OWL + "inverseOf", uri(one), "uri", None)}
        parts = [spark.createDataFrame(sorted(facts, key=str), "s string, p string, o string, o_kind string, datatype string")]
        none = F.lit(None).cast("string")
        individual = lambda t, c: F.concat(F.lit(f"{base_uri}{slug(t)}/"), ascii_slug(c))
        for name, ts in types.items():
            table = self.owner.tables[name]
            s = individual(name, F.col("_record")).alias("s")
            parts.append(table.select(s, F.lit(RDF + "type").alias("p"), F.lit(uri(name)).alias("o"), F.lit("uri").alias("o_kind"), none.alias("datatype")))
            parts.append(table.select(s, F.lit(RDFS + "label").alias("p"), F.col("_record").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XS + "string").alias("datatype")))
            for f in ts.fields:
                if f.name not in table.columns:
                    continue
                c = F.col(f"`{f.name}`")
                p = F.lit(uri(f.name)).alias("p")
                if f.effective_type in LINK_TYPES:
                    each = table.select(s, F.explode(relations._as_array(f)).alias("raw")).where(links.is_link(F.col("raw")))
                    parts.append(each.select("s", p, individual(f.link_target or name, links.link_name(F.col("raw"))).alias("o"), F.lit("uri").alias("o_kind"), none.alias("datatype")))
                    continue
                each = table.select(s, F.explode(c).alias("v")) if f.effective_type in LIST_TYPES else table.select(s, c.alias("v"))
                text = F.date_format("v", "yyyy-MM-dd'T'HH:mm:ss") if f.effective_type == FieldType.DATETIME else F.col("v").cast("string")
                kind = XSD.get(f.effective_type)
                parts.append(each.where("v is not null").select("s", p, text.alias("o"), F.lit("literal").alias("o_kind"), (F.lit(XS + kind) if kind else none).alias("datatype")))
        return reduce(DataFrame.unionByName, parts).distinct()

    def ntriples(self, base_uri: str = "http://collection/") -> DataFrame:
        """(line): each triple as a line of N-Triples."""
        o = F.col("o")
        for char, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            o = F.replace(o, F.lit(char), F.lit(escaped))
        literal = F.concat(F.lit('"'), o, F.lit('"'), F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
        object_ = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
        return self.triples(base_uri).select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), object_, F.lit(" .")).alias("line"))

    def to_ntriples(self, path: str, base_uri: str = "http://collection/") -> None:
        self.ntriples(base_uri).write.mode("overwrite").text(path)

    def to_turtle(self, base_uri: str = "http://collection/") -> str:
        """Turtle for a graph that fits the driver; to_ntriples() has no such bound."""
        by: dict[str, list[str]] = {}
        for r in self.ntriples(base_uri).orderBy("line").collect():
            s, p, rest = r["line"].split(" ", 2)
            by.setdefault(s, []).append(f"{p} {rest[:-2]}")
        return "\n".join(f"{s}\n    " + " ;\n    ".join(po) + " .\n" for s, po in by.items())

    # -- exchange formats for graphs that fit the driver ---------------------------------------------------------

    def _local(self, directed: bool):
        nodes = [(r["id"], {"type": r["type"], **r["attrs"]}) for r in self.flattened().orderBy("id").collect()]
        known = {n for n, _ in nodes}
        pairs = sorted({(r[0], r[1], r[2]) for r in self.edges().select("source", "target", "field").collect()})
        if not directed:
            pairs = sorted({(min(a, b), max(a, b), f) for a, b, f in pairs})
            pairs = list({(a, b): (a, b, f) for a, b, f in pairs}.values())
        nodes += [(n, {}) for n in sorted({x for a, b, _ in pairs for x in (a, b)} - known)]
        return nodes, pairs

    def to_networkx(self, directed: bool = True):
        import networkx

        nodes, pairs = self._local(directed)
        g = networkx.DiGraph() if directed else networkx.Graph()
        g.add_nodes_from(nodes)
        g.add_edges_from((a, b, {"field": f}) for a, b, f in pairs)
        return g

    def to_graphml(self, path: str, directed: bool = True) -> None:
        nodes, pairs = self._local(directed)
        keys = sorted({k for _, attrs in nodes for k in attrs})
        out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
        out += [f'<key id="n{i}" for="node" attr.name={quoteattr(k)} attr.type="string"/>' for i, k in enumerate(keys)]
        out += ['<key id="field" for="edge" attr.name="field" attr.type="string"/>', f'<graph edgedefault="{"directed" if directed else "undirected"}">']
        place = {k: i for i, k in enumerate(keys)}
        for n, attrs in nodes:
            out.append(f"<node id={quoteattr(n)}>" + "".join(f'<data key="n{place[k]}">{_text(v)}</data>' for k, v in attrs.items()) + "</node>")
        out += [f'<edge source={quoteattr(a)} target={quoteattr(b)}><data key="field">{_text(f)}</data></edge>' for a, b, f in pairs]
        _save(path, [*out, "</graph>", "</graphml>"])

    def to_gexf(self, path: str, directed: bool = True) -> None:
        nodes, pairs = self._local(directed)
        keys = sorted({k for _, attrs in nodes for k in attrs})
        place = {k: i for i, k in enumerate(keys)}
        out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', f'<graph defaultedgetype="{"directed" if directed else "undirected"}">', '<attributes class="node">']
        out += [f'<attribute id="{i}" title={quoteattr(k)} type="string"/>' for i, k in enumerate(keys)] + ["</attributes>", "<nodes>"]
        for n, attrs in nodes:
            out.append(f"<node id={quoteattr(n)} label={quoteattr(n)}><attvalues>" + "".join(f'<attvalue for="{place[k]}" value={quoteattr(str(v))}/>' for k, v in attrs.items()) + "</attvalues></node>")
        out += ["</nodes>", "<edges>"] + [f'<edge id="{i}" source={quoteattr(a)} target={quoteattr(b)} label={quoteattr(f)}/>' for i, (a, b, f) in enumerate(pairs)]
        _save(path, [*out, "</edges>", "</graph>", "</gexf>"])


def _text(value: object) -> str:
    from xml.sax.saxutils import escape

    return escape(str(value))


def _save(path: str, lines: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")

