"""Paths of any JSON, and rules over them, against plain walks."""

import json

import pytest

from heddle import catalog
from heddle.operators import json_rules as J


def rows_of(x, path="", pattern=""):
    kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "boolean" if isinstance(x, bool) else "null" if x is None else "string" if isinstance(x, str) else "number"
    out = [(path, pattern, kind)]
    if kind == "object":
        for k, v in x.items():
            if not k.startswith("_"):
                out += rows_of(v, f"{path}.{k}".lstrip("."), f"{pattern}.{k}".lstrip("."))
    if kind == "array":
        for i, v in enumerate(x):
            out += rows_of(v, f"{path}[{i}]", f"{pattern}[*]")
    return out


DOCUMENTS = [
    {"a": [1, [2, {"b": None, "_x": 1}], "t", True], "_note": {"c": 1}, "d": {}},
    [], 5, "x", None, {"k": 1.5e300, "ü.v": "é"},
]


def test_every_value_has_its_path(spark):
    docs = [(str(i), json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [("bad", '{"a": 1,\n "b": }'), ("none", None), ("again", "[1]"), ("again", "[1]")]
    got = J.flatten(spark.createDataFrame(docs, "id string, json string").repartition(3)).collect()
    for i, d in enumerate(DOCUMENTS):
        assert sorted((r.path, r.pattern, r.type) for r in got if r.id == str(i)) == sorted(rows_of(d))
    bad = [r for r in got if r.type == "invalid"]
    assert {r.id for r in bad} == {"bad", "none"} and next(r.value for r in bad if r.id == "bad").endswith("(line 2, column 7)")
    assert sum(r.id == "again" for r in got) == 4
    deep = json.dumps(1)
    for _ in range(300):
        deep = f"[{deep}]"
    assert J.flatten(spark.createDataFrame([("d", deep)], "id string, json string")).count() == 301


GOOD = {
    "estructuras": [{"k": "a", "n": "A", "c": "#00ff00", "a": 0.5}, {"k": "b", "n": "B", "con": "a"}], "foco_ocultar": ["b"],
    "ruta": {"puntos": [[0, 0, 0], [1, 0, 0], [2, 0, 0]], "radios": [1, 1, 1], "vel": 1, "zonas": [{"desde": 0, "hasta": 2}], "estrechez": {"desde": 0, "hasta": 1, "luz_normal": [1, 2], "clave": "a"}},
    "vistas": {"v1": {"dir": [0, 0, 1], "radio": 2}}, "vista_inicial": "v1", "hotspots": [{"n": 1, "t": "x", "p": "a", "k": "a"}], "flujo": {"vista": "v1"},
    "secuencias": {"s": [{"t": "x", "luz": [1], "pared": [1], "desde": 1, "hasta": 1}, {"t": "y", "escala": {"a": 2}}]},
    "reseccion": {"opciones": {"o": {"saca": ["a"], "planos": [{"queda": [{"ruta": 1, "queda": "antes"}]}]}}}, "seg_etapa": 3,
}

#: What to change in the good document, and the rule and path that then complain.
FAULTS = [
    (("estructuras", []), ("structures", "estructuras")), (("estructuras.0.a", True), ("structure opacity", "estructuras[0].a")), (("estructuras.0.a", 1.01), ("structure opacity", "estructuras[0].a")),
    (("estructuras.1.k", "a"), ("structure key", "estructuras[1].k")), (("estructuras.1.k", "é"), ("structure key", "estructuras[1].k")), (("estructuras.0.n", "  "), ("structure name", "estructuras[0].n")),
    (("estructuras.0.c", "#00ff0"), ("structure colour", "estructuras[0].c")), (("estructuras.1.con", "z"), ("structure with", "estructuras[1].con")), (("foco_ocultar", ["b", "q"]), ("hidden in focus", "foco_ocultar[1]")),
    (("foco_ocultar", "b"), ("hidden list", "foco_ocultar")), (("ruta.puntos", [[0, 0, 0]]), ("course", "ruta.puntos")), (("ruta.radios", [1, 1]), ("course radii", "ruta.radios")), (("ruta.vel", 0), ("course speed", "ruta.vel")),
    (("ruta.zonas.0.hasta", 3), ("zone to", "ruta.zonas[0].hasta")), (("ruta.estrechez", {"desde": 1}), ("narrow span", "ruta.estrechez")), (("ruta.estrechez.desde", 1), ("narrow span", "ruta.estrechez")),
    (("ruta.estrechez.luz_normal", [1]), ("narrow light", "ruta.estrechez.luz_normal")), (("ruta.estrechez.clave", "z"), ("narrow key", "ruta.estrechez.clave")), (("vistas.v1.dir", [0, 1]), ("view direction", "vistas.v1.dir")),
    (("vistas.v1.dir", [0, 1, "z"]), ("view direction number", "vistas.v1.dir[2]")), (("vistas.v1.radio", "2"), ("view radius", "vistas.v1.radio")), (("vista_inicial", "v2"), ("first view", "vista_inicial")),
    (("hotspots", [{"n": 1, "t": "x", "p": "a"}, {"n": 1, "t": "y", "p": "b"}]), ("spot number", "hotspots[1].n")), (("hotspots.0", {"n": 1, "t": "x"}), ("spot", "hotspots[0]")), (("hotspots.0.k", "z"), ("spot key", "hotspots[0].k")),
    (("flujo.vista", "v9"), ("flow view", "flujo.vista")), (("secuencias.s", []), ("steps", "secuencias.s")), (("secuencias.s.0", {"t": "x", "luz": [1]}), ("step", "secuencias.s[0]")),
    (("secuencias.s.1.escala.a", 0), ("step factor", "secuencias.s[1].escala.a")), (("secuencias.s.0.hasta", 2), ("step light", "secuencias.s[0].luz")), (("reseccion", {"otra": 1}), ("resection", "reseccion")),
    (("reseccion.opciones.o.saca", ["z"]), ("resection key", "reseccion.opciones.o.saca[0]")), (("reseccion.opciones.o.planos.0.queda.0.queda", "x"), ("resection side", "reseccion.opciones.o.planos[0].queda[0].queda")), (("seg_etapa", 61), ("stage seconds", "seg_etapa")),
]


def changed(path, value):
    d = json.loads(json.dumps(GOOD))
    at, *keys = d, *path.split(".")
    for k in keys[:-1]:
        at = at[int(k) if isinstance(at, list) else k]
    at[int(keys[-1]) if isinstance(at, list) else keys[-1]] = value
    return json.dumps(d)


def test_each_fault_is_found_where_it_is_and_a_good_document_is_left_alone(spark, tmp_path):
    docs = [("good", json.dumps(GOOD)), ("empty", "{}"), ("broken", "{")] + [(f"{i}", changed(*change)) for i, (change, _) in enumerate(FAULTS)]
    J.flatten(spark.createDataFrame(docs, "id string, json string")).write.parquet(str(tmp_path / "rows"))
    found = {}
    for r in J.violations(spark.read.parquet(str(tmp_path / "rows")), J.VIEWER).collect():
        found.setdefault(r.id, set()).add((r.rule, r.path))
    assert "good" not in found and "empty" not in found and found["broken"] == {("json", "")}
    for i, (_, want) in enumerate(FAULTS):
        assert want in found.get(str(i), ()), (want, found.get(str(i)))


@pytest.mark.parametrize("pattern,path,hit", [("a.*.b", "a.x.b", True), ("a.*.b", "a.x.y.b", False), ("a[*].b", "a[*].b", True), ("a.*[*]", "a.x[*]", True), ("a.*[*]", "a.x", False), ("a.b", "aXb", False)])
def test_patterns(spark, pattern, path, hit):
    d = spark.createDataFrame([(path,)], "pattern string")
    assert d.where(J.matching(pattern)).count() == int(hit)


ODD = [
    '{"vistas": {"a": {"dir": [0, NaN, 1e400], "radio": -Infinity}, "_b": {"dir": 1}}, "seg_etapa": 1' + "0" * 400 + "}", '{"seg_etapa": 1' + "0" * 5000 + "}", '{"estructuras": [{"k": "a\\n", "n": "\\u00a0"}, {"k": 1, "n": "\\u001f"}, {"k": 1}, {"k": 1.0}, {"k": {}}, {"k": {}}, 7]}',
    '{"estructuras": [{"k": "a", "con": null}, {"k": "a", "con": true}, {"k": "a", "con": ["a"]}], "ruta": {"puntos": {"0": 1}, "radios": [], "zonas": [{"desde": "0", "hasta": 0.5}, {"desde": -1, "hasta": null}]}}',
    '{"ruta": {"puntos": [0, 0], "estrechez": {"desde": 0.0, "hasta": true, "luz_normal": [1], "_x": 1}, "zonas": [{"desde": 1.5, "hasta": 1}]}}', '{"ruta": [{"puntos": []}], "vistas": [{"dir": 1}], "ruta.vel": 0, "vistas.x": 3}',
    '{"ruta": {"estrechez": {"desde": 1, "hasta": 3, "luz_normal": [1, 2]}, "estrechez": {"desde": 1, "hasta": 3, "luz_normal": [1, 2, 3, 4]}}}', '{"hotspots": [{"n": 2, "t": "x", "p": "y"}, {"n": 1}, {"n": 2}, {"n": 2.0}, {"n": "2"}], "foco_ocultar": ["0", 0, {}]}',
    '{"estructuras": [' + ", ".join('{"k": "s", "n": "x"}' for _ in range(12)) + "]}", '{"estructuras": [{"k": "\\ud800", "n": " "}]}', '[{"estructuras": []}]', "3", "null", "[" * 100_000, None, "",
]


def test_documents_are_judged_as_their_rows_are(spark, tmp_path, monkeypatch):
    docs = [("good", json.dumps(GOOD)), ("broken", "{")] + [(f"{i}", changed(*change)) for i, (change, _) in enumerate(FAULTS)] + [(f"odd{i}", d) for i, d in enumerate(ODD)]
    d = spark.createDataFrame(docs, "id string, json string").repartition(3)
    J.flatten(d).write.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(J, "KEYS", 2)
    monkeypatch.setattr(J, "FEW", 3)
    rules = J.VIEWER + [J.Rule("all", "", types=("object",), needs=("_a", "vistas"), least=2), J.Rule("listed", "estructuras[*].n", one_of=("A", "x"), known=("estructuras[*].n", "vistas.*")), J.Rule("digits", "estructuras[*].k", like=r"\p{Alpha}[\d&&[^1]]*")]
    found = J.checked(d, rules)
    want = sorted(map(repr, J.violations(spark.read.parquet(str(tmp_path / "rows")), rules).collect()))
    assert sorted(map(repr, found.collect())) == want and len(want) > 150


def test_viewer_documents_shuffles_orders_once_and_nothing_else(spark, sf):
    plan = catalog.queries()["viewer_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("Exchange") == 1 and "Join" not in plan


def test_a_document_has_no_other_documents_values(spark):
    d = spark.createDataFrame([("a", '{"vista_inicial": "v"}'), ("a", '{"vistas": {"v": {}}}')], "id string, json string")
    assert [tuple(r) for r in J.checked(d, J.VIEWER).collect()] == [("a", "vista_inicial", "first view", "v")]
