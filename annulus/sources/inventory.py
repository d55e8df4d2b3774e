"""The node inventory over its REST interface, as the tables that label resolution joins."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import camel

NODE = "criteria string, id bigint, label string, location string, foreign_source string, foreign_id string, categories array<string>, assets map<string,string>"
INTERFACE = "node_id bigint, if_name string, if_descr string, phys_addr string, collect boolean"
ADDRESS = "ip string, node_id bigint"


def parse_node(node: dict) -> dict:
    """A node's row; assets are its record's fields that hold something."""
    assets = {k: str(v) for k, v in (node.get("assetRecord") or {}).items() if not isinstance(v, (dict, list)) and v not in (None, "")}
    return {
        "id": int(node["id"]), "label": node.get("label"), "location": node.get("location"), "foreign_source": node.get("foreignSource"), "foreign_id": node.get("foreignId"),
        "categories": [c["name"] for c in node.get("categories") or []], "assets": {camel(k): v for k, v in assets.items()},
    }


#: What of a node's answer is read; the record's values stay JSON, so that texts and objects can be told apart.
_ANSWER = "id string, label string, location string, foreignSource string, foreignId string, categories array<struct<name:string>>, assetRecord map<string,variant>"


def node_columns(answer: Column) -> dict[str, Column]:
    """parse_node() as column expressions over answers as JSON texts."""
    node = F.from_json(answer, _ANSWER)
    kept = F.map_filter(node["assetRecord"], lambda k, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)") & (v.cast("string") != ""))
    head = lambda k: F.split(k, "-")
    camel_key = lambda k: F.concat(F.get(head(k), 0), F.array_join(F.transform(F.slice(head(k), F.lit(2), F.size(head(k))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""))
    texts = F.transform(F.map_entries(F.coalesce(kept, F.create_map().cast("map<string,variant>"))), lambda e: F.struct(camel_key(e["key"]).alias("key"), e["value"].cast("string").alias("value")))
    return {
        "id": node["id"].cast("long"), "label": node["label"], "location": node["location"], "foreign_source": node["foreignSource"], "foreign_id": node["foreignId"],
        "categories": F.coalesce(F.transform(node["categories"], lambda c: c["name"]), F.array().cast("array<string>")), "assets": F.map_from_entries(texts),
    }


@dataclass
class Inventory:
    url: str
    user: str
    password: str

    def _get(self, path: str) -> object | None:
        """None for 204 and 404; refused credentials and other failures are errors."""
        secret = base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        request = urllib.request.Request(self.url.rstrip("/") + path, headers={"Accept": "application/json", "Authorization": f"Basic {secret}"})
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                return None if answer.status == 204 else json.loads(answer.read())
        except urllib.error.HTTPError as x:
            if x.code == 404:
                return None
            raise OSError("the inventory refused the credentials" if x.code in (401, 403) else f"the inventory answered {x.code}") from x

    def ping(self) -> None:
        self._get("/api/v2/nodes?limit=1")

    def node(self, criteria: str) -> dict | None:
        found = self._get("/api/v2/nodes/" + urllib.parse.quote(criteria, safe=":"))
        return parse_node(found) if found else None

    def nodes_by_ip(self, ip: str) -> list[dict]:
        found = self._get("/api/v2/nodes?" + urllib.parse.urlencode({"_s": f"ipInterface.ipAddress=={ip}", "limit": 0}))
        return [parse_node(n) for n in (found or {}).get("node", [])]

    def interfaces(self, node_id: int) -> list[dict]:
        found = self._get(f"/api/v2/nodes/{node_id}/snmpinterfaces?limit=0")
        return [{"node_id": node_id, "if_name": i.get("ifName"), "if_descr": i.get("ifDescr"), "phys_addr": i.get("physAddr"), "collect": bool(i.get("collect"))} for i in (found or {}).get("snmpInterface", [])]


def load(spark: SparkSession, inventory: Inventory, criteria: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, interfaces, addresses) for distinct criteria (ip:<address>, fs:fid or a number)."""
    nodes, interfaces, addresses = {}, [], []
    for c in criteria:
        found = inventory.nodes_by_ip(c[3:]) if c.startswith("ip:") else [n for n in [inventory.node(c)] if n]
        addresses += [(c[3:], n["id"]) for n in found if c.startswith("ip:")]
        nodes |= {n["id"]: {"criteria": c} | n for n in found}
    for i in nodes:
        interfaces += inventory.interfaces(i)
    return spark.createDataFrame(list(nodes.values()), NODE), spark.createDataFrame(interfaces, INTERFACE), spark.createDataFrame(addresses, ADDRESS)
