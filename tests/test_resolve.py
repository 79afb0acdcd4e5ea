"""Entity resolution, enrichment, discovery and the nightly run on hand-written records."""

import json
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from plazaflow.functions import arrays
from plazaflow.operators import discover, enrich, folding, geocoding, index, joins, merging, pipeline, predicates, publish, resolve, validate
from plazaflow.operators.normalize import normalize_news, normalize_plans
from plazaflow.plans import dims, fixtures, schema
from plazaflow.plans.compat import Compat
from plazaflow.plans.storage import kept

TODAY = "2024-01-15"


def today():
    return F.lit(TODAY).cast("date")


def now():
    return F.lit(f"{TODAY} 12:00:00").cast("timestamp_ntz")


def raw(spark, records):
    names = list(schema.fields(schema.RAW))
    rows = [tuple({**r, "_ord": r.get("_ord", k)}.get(n) for n in names) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, schema.RAW)


def canonical(spark, records):
    return kept(normalize_plans(raw(spark, records), today(), "2024-01-15T04:15:00Z", keep_only_current=False))


def plan(fuente, titulo, day=None, lugar=None, **more):
    return {"fuente": fuente, "id": more.pop("id", titulo[:5] + (day or "")), "titulo": titulo, "fecha_inicio": day, "lugar": lugar, **more}


def test_exact_merge(spark):
    shared = "https://shop/x"
    plans = canonical(
        spark,
        [
            plan("fever", "Concierto de Jazz", "2024-01-20", "Sala Uno", url=shared, precio="15", id="f1"),
            plan("datos_madrid", "Concierto de Jazz", "2024-01-20", "Sala Uno", url=shared + "/", precio="0", descripcion="Una noche larga de jazz", id="d1"),
            plan("esmadrid", "Otra cosa distinta", "2024-01-21", "Teatro", url="https://e/1", id="e1"),
        ],
    )
    got = {r._ord: r for r in resolve.merge_exact(plans).collect()}
    assert set(got) == {0, 2}
    one = got[0]
    assert (one.fuente, one.precio, one.es_gratis) == ("datos_madrid", 15.0, False)  # a free primary takes the other's price
    assert [x.fuente for x in one.source_links] == ["fever"]  # the later primary's own link is lost
    assert one.ids_relacionados == ["datos_madrid:d1", "fever:f1"] and one.fuentes_relacionadas == ["datos_madrid", "fever"]
    assert [x.fuente for x in got[2].source_links] == ["esmadrid"]


def test_same_day_and_recurring(spark):
    records = [
        plan("matadero", "Acto Solemne de Izado de la Bandera", "2024-01-20", "Plaza", id="a"),
        plan("fever", "Izado solemne de la Bandera, acto de", "2024-01-20", "Plaza Mayor", id="b"),
        plan("fever", "Bandera", "2024-01-20", "Plaza", id="c"),
        plan("fever", "Una película muy larga", "2024-01-21", "Cine Sol", id="d"),
        plan("wegow", "Una película muy larga", "2024-01-22", "Cine Luna", id="e"),
        *(plan("wegow", "Obra de teatro clásica", f"2024-01-{d}", "Teatro Real", id=f"t{d}") for d in (17, 18, 19)),
        *(plan("wegow", "Danza contemporánea nueva", f"2024-01-{d}", "Casa del Reloj" + x, id=f"z{d}") for d, x in ((17, ""), (18, " (Arganzuela)"))),
        plan("wegow", "Matadero sin lugar alguno", "2024-01-25", None, id="n1"),
        plan("fever", "Matadero sin lugar alguno", "2024-01-25", "Matadero", id="n2"),
    ]
    got = resolve.merge_plans(canonical(spark, records), TODAY).collect()
    by = {}
    for r in got:
        for i in r.ids_relacionados:
            assert i not in by
            by[i] = r
    assert len(by) == len(records)  # no record is lost
    assert by["matadero:a"] is by["fever:b"] and by["fever:c"] is not by["matadero:a"]
    assert by["fever:d"] is not by["wegow:e"]
    three, two = by["wegow:t17"], by["wegow:z17"]
    assert three is by["wegow:t19"] and three.modo_fecha == "multiple" and len(three.sesiones) == 3 and three.fecha_fin == "2024-01-19"
    assert two is by["wegow:z18"] and two.modo_fecha == "puntual" and two.proxima_fecha == "2024-01-17"
    assert by["wegow:n1"] is not by["fever:n2"]  # no venue is a venue of its own
    assert by["matadero:a"].id.startswith("plan:merged:") and by["matadero:a"].fuente == "matadero"


def test_partitions_do_not_matter(spark):
    plans = canonical(spark, [plan(["fever", "matadero", "wegow"][k % 3], f"Un título común {k % 4}", f"2024-01-{16 + k % 5}", f"Sala {k % 2}", id=str(k)) for k in range(40)])
    rows = lambda df: sorted((r.id, r.titulo, r.fecha_inicio, r.precio, tuple(sorted(r.ids_relacionados))) for r in resolve.merge_plans(df, TODAY).collect())
    assert rows(plans) == rows(plans.repartition(7)) == rows(plans.coalesce(1))


@pytest.mark.parametrize("frequent", [1_000, 3])
def test_containment_pairs(spark, monkeypatch, frequent):
    """Every pair once, whether tokens are rare or frequent."""
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    r = random.Random(5)
    rows = [(k, k % 2, sorted(r.sample("abcdefg", r.randint(1, 5)))) for k in range(90)]
    want = sorted((a, b) for a, x, s in rows for b, y, t in rows if a != b and x == y and set(s) <= set(t) and (len(s) >= 3 or len(s) == len(t)))
    got = joins.containment_pairs(spark.createDataFrame(rows, "id long, block int, tokens array<string>"), "id", "block", "tokens").collect()
    assert sorted(tuple(x) for x in got) == want and want


def test_prefix_chains_over_ranges(spark):
    r = random.Random(6)
    values = sorted({"".join(r.choice("ab-ñ") for _ in range(r.randint(0, 7))) for _ in range(400)} | {"a" * k for k in range(40)})
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "value string").repartition(5)
    got = {x.value: list(x.heads) for x in joins.prefix_chains(df).collect()}
    assert got == {v: [h for h in sorted(values, key=len) if v.startswith(h)] for v in values}
    assert not joins.prefix_chains(df.limit(0)).count()


def test_hub_titles_make_a_group_for_each_root(spark):
    """A title that all others hold joins them by places, not as one group; a generic place ties them all."""
    records = [plan("fever", f"Gran concierto de jazz numero{k} especial", "2024-01-20", f"Sala {'abcdefghij'[k]}", id=f"t{k}") for k in range(10)]
    hub = [plan("wegow", "Gran concierto de jazz", "2024-01-20", f"Sala {c}", id=f"h{c}") for c in "abcdefghij"]
    plans = canonical(spark, records + hub).withColumns({"_tokens": resolve.title_tokens("titulo"), "_day": F.col("fecha_inicio"), "_at": resolve.place_key("lugar", "direccion")})

    def groups(df):
        dated = df.withColumns({"_class": F.xxhash64("_day", "_tokens"), "_root": F.col("_at")}).withColumn("_node", F.xxhash64("_class", F.coalesce("_root", F.lit(""))))
        return resolve.day_groups(dated).groupBy("_group").count().collect()

    assert sorted(x["count"] for x in groups(plans)) == [2] * 10
    assert len(groups(plans.withColumn("_at", F.when(F.col("fuente_id") != "ha", F.col("_at"))))) == 1
    assert len(resolve.merge_same_day(resolve.merge_exact(plans.drop("_tokens", "_day", "_at"))).collect()) == 10


def test_merge_news(spark):
    items = [{"fuente": "timeout", "id": str(k), "titulo": f"T{k}", "url": f"https://n/{k % 2}", "descripcion": "x" * (10 + k), "categorias": [f"C{k}"], "fecha_publicacion": "2024-01-10"} for k in range(4)]
    news = kept(normalize_news(raw(spark, items), now(), "2024-01-15T04:15:00Z"))
    got = {r.url: r for r in resolve.merge_news(news).collect()}
    assert got["https://n/0"].titulo == "T0" and len(got["https://n/0"].descripcion) == 12 and got["https://n/0"].categorias == ["C0", "C2"]
    assert got["https://n/1"].ids_relacionados == ["timeout:1", "timeout:3"]
    told = news.withColumn("metadata", F.when(F.col("fuente_id") == "0", F.expr("map('a', '', 'b', 'x')")).when(F.col("fuente_id") == "2", F.expr("map('a', 'y', 'b', 'z', 'c', '')")))
    told = told.withColumns({"etiquetas": F.array(F.lit("Uno"), F.concat(F.lit("UNO "), F.lit("")), F.col("fuente_id")), "url": F.when(F.col("fuente_id") != "3", F.col("url"))})
    got = {r.ids_relacionados[0]: r for r in resolve.merge_news(told.withColumn("id", F.when(F.col("fuente_id") != "3", F.col("id")))).collect()}
    assert got["timeout:0"].metadata == {"a": "y", "b": "x", "c": ""} and got["timeout:0"].etiquetas == ["Uno", "0", "2"]
    assert set(got) == {"timeout:0", "timeout:1", "timeout:3"} and got["timeout:1"].metadata == {}


def test_index_equals_the_scan(spark, sf_dir, tmp_path, monkeypatch):
    """Searches through the index give what a scan gives, and read the buckets that may hold it."""
    monkeypatch.setattr(index, "SIZE", 16)
    view = kept(discover.view_events(fixtures.feed(spark, sf_dir), now()))
    built = index.build(view, f"{tmp_path}/index")
    word = next(w for w in view.orderBy("id").first().search_blob.split() if len(w) > 8)
    states = [discover.State(), discover.State(query=word), discover.State(query=f"{word[1:6].upper()} {word[:2]}"), discover.State(query="nowhere at all"), discover.State(source="fever"), discover.State(category="Cine", free_only=True), discover.State(query="the", source="fever", date_filter="week"), discover.State(query="q")]
    for state in states:
        got, want = (sorted(r.id for r in df.select("id").collect()) for df in (index.matching(built, state), discover.filtered(view, state)))
        assert got == want
    buckets = built.feed.select("_bucket").distinct().count()
    assert buckets > 5 and index.candidates(built, index.keys_of_search(states[1])).count() < buckets
    plan = index.matching(built, states[1])._jdf.queryExecution().executedPlan().toString()
    assert "In(_bucket" in plan or "EqualTo(_bucket" in plan  # pushed to the scan
    rows = lambda df: sorted(tuple(r) for r in df.select("facet", "value", "n", "first").collect())
    assert rows(index.facets(built)) == rows(discover.facets(view))
    none = index.build(view.limit(0), f"{tmp_path}/none")
    assert not index.matching(none, states[1]).count() and not index.facets(none).count()


def test_classify(spark):
    rows = [("Concierto de jazz y teatro", None, "fever"), ("Nada", "una visita al parque infantil", "fever"), ("Nada", None, "x"), ("MÚSICA en directo", "cine", "x"), ("Parque infantil", None, "x")]
    df = spark.createDataFrame([(t, d, f, k) for k, (t, d, f) in enumerate(rows)], "titulo string, descripcion string, fuente string, _ord long")
    got = [r.categorias_normalizadas for r in enrich.classify(df).orderBy("_ord").collect()]
    assert got == [["Música y Conciertos", "Teatro y Danza"], ["Familia e Infantil", "Visitas y Rutas"], ["Ocio y Entretenimiento"], ["Música y Conciertos", "Cine"], ["Familia e Infantil"]]


def test_geocode(spark, tmp_path, monkeypatch):
    plans = canonical(spark, [plan("fever", "A", lugar="Calle Mayor 1", id="1"), plan("fever", "B", lugar="Madrid", id="2"), plan("fever", "C", lugar="Gran Vía 2, Madrid", id="3"), plan("fever", "D", lugar="Lejos de aquí", id="4")])
    cache = spark.createDataFrame([("calle mayor 1, madrid, españa", 40.4, -3.7, "q")], schema.GEOCODE)
    points = {"gran vía 2, madrid, españa": (40.42, -3.7), "lejos de aquí, madrid, españa": (10.0, 10.0)}
    cache.write.parquet(f"{tmp_path}/cache")
    got = {r.fuente_id: r.latitud for r in geocoding.geocoded(plans, f"{tmp_path}/cache", points.get, pause=0).collect()}
    assert got == {"1": 40.4, "2": None, "3": 40.42, "4": None}
    assert {r.cache_key: r.lat for r in geocoding.read(spark, f"{tmp_path}/cache").collect()} == {"calle mayor 1, madrid, españa": 40.4, "gran vía 2, madrid, españa": 40.42, "lejos de aquí, madrid, españa": None}


def test_lookups_are_paced_stored_and_never_made_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geocoding, "BATCH", 2)
    plans = canonical(spark, [plan("fever", f"T{k}", lugar=f"Calle Larga {k}", id=str(k)) for k in range(7)])
    calls, cache = f"{tmp_path}/calls", f"{tmp_path}/cache"

    def resolver(fails):
        def ask(key):
            with open(calls, "a") as out:
                out.write(f"{time.time()} {key}\n")
            if key == fails:
                raise RuntimeError("killed")
            if "larga 6" in key:
                raise TimeoutError
            return 40.4, -3.7

        return ask

    with pytest.raises(Exception):
        geocoding.look_up(plans, cache, resolver("calle larga 3, madrid, españa"), pause=0.05)
    stored = {r.cache_key for r in geocoding.read(spark, cache).collect()}
    assert stored == {f"calle larga {k}, madrid, españa" for k in (0, 1)}  # whole batches
    assert geocoding.look_up(plans, cache, resolver(None), most=4, pause=0.05) == 4
    assert geocoding.look_up(plans, cache, resolver(None), pause=0.05) == 1
    asked = [line.split(" ", 1) for line in open(calls).read().splitlines()]
    assert not geocoding.look_up(plans, cache, resolver(None), pause=0.05) and len(open(calls).read().splitlines()) == len(asked)
    after = [key for _, key in asked][-5:]
    assert after == [f"calle larga {k}, madrid, españa" for k in range(2, 7)]
    assert all(float(b[0]) - float(a[0]) >= 0.05 for a, b in zip(asked, asked[1:]))
    assert {r.fuente_id: r.latitud for r in geocoding.geocoded(plans, cache).collect()} == {str(k): 40.4 if k < 6 else None for k in range(7)}


def test_shared_purchase(spark):
    plans = canonical(spark, [plan("esmadrid", "A", id="1", url_compra="http://s"), plan("esmadrid", "B", id="2", url_compra="http://s"), plan("fever", "C", id="3", url_compra="http://s")])
    got = {r.fuente_id: (r.url_compra, (r.metadata or {}).get("url_compra_original")) for r in enrich.shared_purchase_urls(plans).collect()}
    assert got == {"1": (None, "http://s"), "2": (None, "http://s"), "3": ("http://s", None)}


def test_diversify(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate("AAAB", 1)], "rank int, primary_category string")
    got = sorted((r.place, r.primary_category) for r in discover.diversify(df, 10).collect())
    assert "".join(c for _, c in got) == "AABA"
    assert not discover.diversify(df.limit(0), 10).collect()


def test_diversify_reaches_far_down(spark, monkeypatch):
    kinds = "A" * 300 + "BBBC" + "A" * 5 + "CCCC"
    df = spark.createDataFrame(list(enumerate(kinds, 1)), "rank int, primary_category string").repartition(4)
    shown, waiting = [], []
    blocked = lambda k: len(shown) > 1 and kinds[shown[-1]] == kinds[shown[-2]] == kinds[k]
    for k in range(len(kinds)):  # the reference, over the whole list
        if blocked(k):
            waiting.append(k)
            continue
        shown.append(k)
        while (free := next((w for w in waiting if not blocked(w)), None)) is not None:
            waiting.remove(free)
            shown.append(free)
    wanted = [k + 1 for k in shown + waiting]
    for most, segment in ((1, 9), (6, 9), (12, 9), (None, 7), (None, 40), (None, 1 << 18)):
        monkeypatch.setattr(discover, "SEGMENT", segment)
        got = [r["rank"] for r in sorted(discover.diversify(df, most).collect(), key=lambda r: r.place)]
        assert got == wanted[:most]


def test_segments_of_a_varied_list():
    """Sums of segments, composed, give the state that row after row gives, for lists of any mixture."""
    r = random.Random(4)
    looked = 0
    for trial in range(300):
        kinds = [r.choice(["AAAAB", "ABC", "AABCD", "BBBBA"][k // 40 % 4]) for k in range(r.randint(0, 160))]
        state = plain = discover.START
        while kinds:
            part, kinds = kinds[: (n := r.randint(1, 50))], kinds[n:]
            summary = json.loads(json.dumps(discover.segment_ends(part)))
            summary["by"] = {tuple(s): tuple(e) for s, e in summary["ends"]}
            for kind in part:
                plain = discover.shown_after(plain, kind)
            state = discover.known_end(summary, state)
            looked += state is None
            assert state in (None, plain)
            state = plain
    assert 0 < looked < 200


def test_ranks_are_whole(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = sorted((r.rank, r.v, r.id) for r in discover.with_rank(df, [F.col("v"), F.col("id")]).collect())
    assert [g[0] for g in got] == list(range(1, 1001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_last_known_good(spark):
    fresh = spark.createDataFrame([("a", 1)], "fuente string, n int")
    old = spark.createDataFrame([("a", 0), ("b", 5)], "fuente string, n int")
    assert sorted(tuple(r) for r in joins.last_known_good(fresh, old, "fuente").collect()) == [("a", 1, False), ("b", 5, True)]


def test_validate(spark):
    plans = canonical(spark, [plan("fever", "A", "2023-01-01", id="1"), plan("fever", "", "2024-02-01", id="2")])
    r = validate.validate_plans(plans, today()).first()
    assert not r.valid and r.total == 2 and r.by_source == {"fever": 2}
    assert r.errors == ["Plan fuera de ventana producto en plan:fever:1", "Titulo vacio en plan:fever:2"]
    assert validate.validate_plans(plans.limit(0), today()).first().valid


def test_nightly_run(spark, tmp_path):
    sources = {
        "fever": raw(spark, [plan("fever", "GRAN CONCIERTO DE JAZZ", "2024-01-20T20:00", "Sala Uno", url="https://s/1", descripcion="Texto &amp; más, bastante largo", id="1", imagen="https://images.unsplash.com/x")]),
        "wegow": raw(spark, [plan("wegow", "Gran concierto de jazz", "2024-01-20T20:00", "Sala Uno", url="https://s/1", id="2")]),
        "timeout": raw(spark, [{"fuente": "timeout", "id": "n", "titulo": "Noticia", "url": "https://n", "fecha_publicacion": "2024-01-14"}]),
    }
    previous = canonical(spark, [plan("meetup", "Intercambio de idiomas", "2024-01-30", "Bar", id="m"), plan("fever", "Viejo", "2024-01-30", "Bar", id="v")])
    old_news = normalize_news(raw(spark, [{"fuente": "gacetin_madrid", "id": "g", "titulo": "Antes", "url": "https://g", "fecha_publicacion": "2024-01-10"}, {"fuente": "timeout", "id": "t", "titulo": "Vieja", "url": "https://t", "fecha_publicacion": "2024-01-10"}]), now(), "2024-01-11T04:15:00Z")
    out = pipeline.run_all(sources, previous, old_news, TODAY, now(), "2024-01-16T04:15:00Z", {"type": "test"}, "2024-01-16T04:16:00Z")
    events = {r.id: r for r in out["web_events"].collect()}
    assert len(events) == 2 and [r.titulo for r in out["web_news"].collect()] == ["Noticia", "Antes"]
    assert [r.titulo for r in out["plans"].collect()] == ["GRAN CONCIERTO DE JAZZ", "Intercambio de idiomas"]
    jazz = next(r for r in events.values() if r.fuentes_relacionadas)
    assert jazz.titulo == "Gran concierto de jazz" and jazz.imagen is None and jazz.descripcion == "Texto & más, bastante largo"
    m = out["manifest"].first()
    assert {s.name: (s.kind, s.status, s.stale_since) for s in m.sources} == {"fever": ("plan", "ok", None), "wegow": ("plan", "ok", None), "meetup": ("plan", "failed", "2024-01-15T04:15:00Z"), "timeout": ("news", "ok", None), "gacetin_madrid": ("news", "failed", "2024-01-11T04:15:00Z")}
    assert m.planes.total == 2 and m.trigger.type == "test"
    publish.write_feed(out["web_events"], str(tmp_path / "feed"))
    assert '"resumen":null' not in "".join(r.value for r in spark.read.text(str(tmp_path / "feed")).collect())
    publish.write_array(out["web_events"], str(tmp_path / "array"))
    (file,) = (tmp_path / "array").glob("part-*")
    assert [r["id"] for r in json.loads(file.read_text())] == [r.id for r in out["web_events"].collect()]
    publish.write_array(out["web_events"].limit(0), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "none").glob("part-*"))) == []


NOTHING = (None, "", [], False)


def slug(x):
    return re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", merging.clean(x)).encode("ascii", "ignore").decode().lower()).strip("-") or dims.EMPTY_SLUG


def venue(r):
    key = slug(r["lugar"] or r["direccion"])
    return None if key in dims.GENERIC_PLACE_SLUGS else key


def tokens(r):
    words = slug(r["titulo"]).split("-")
    return tuple(sorted(set(words))) if len(set(words)) > 1 and sum(map(len, words)) >= 10 else None


def plain_links(*lists):
    out = {}
    for x in (x for links in lists for x in links or [] if x["fuente"] and x["url"]):
        held = out.setdefault((x["fuente"].lower(), x["url"].rstrip("/").lower()), {**x, "kind": x["kind"] or "detalle"})
        held.update({n: x[n] for n in x if held[n] in (None, "")} | ({"kind": "compra"} if x["kind"] == "compra" else {}))
    return list(out.values())


def plain_ids(r):
    return r["ids_relacionados"] or ([f"{r['fuente']}:{r['fuente_id']}"] if r["fuente"] and r["fuente_id"] else [])


def plain_once(values):
    given = [merging.clean(v) for v in values if merging.clean(v)]
    return [v for k, v in enumerate(given) if v.lower() not in [w.lower() for w in given[:k]]]


def pair(held, new):
    """Two records merged, whatever came before: the better one, completed by the other."""
    rank = lambda r: dims.SOURCE_PRIORITY.get(merging.clean(r["fuente"]), dims.NO_PRIORITY)
    score = lambda r: (sum(r[n] not in (None, "", []) for n in merging.COUNTED), len(merging.clean(r["contenido"])), len(merging.clean(r["descripcion"])))
    flip = rank(new) < rank(held) or rank(new) == rank(held) and score(new) > score(held)
    a, b = (new, held) if flip else (held, new)
    take = lambda n: b[n] if a[n] in NOTHING and b[n] not in (None, "", []) else a[n]
    out = {n: take(n) if merging.RULES.get(n) in ("filled", "longest") else v for n, v in a.items()}
    for n in ("contenido", "descripcion", "resumen"):
        out[n] = b[n] if len(merging.clean(b[n])) > len(merging.clean(out[n])) else out[n]
    for n in ("categorias", "etiquetas", "fechas_disponibles"):
        out[n] = plain_once([*(a[n] or []), *(b[n] or [])])
    out["ids_relacionados"] = plain_once(plain_ids(a) + plain_ids(b))
    out["fuentes_relacionadas"] = plain_once([*(a["fuentes_relacionadas"] or [a["fuente"]]), *(b["fuentes_relacionadas"] or [b["fuente"]])])
    times = {s["datetime"] or s["fecha"]: s for s in [*(a["sesiones"] or []), *(b["sesiones"] or [])]}
    out["sesiones"] = [times[k] for k in sorted(k for k in times if k)]
    out["source_links"] = plain_links(a["source_links"], b["source_links"], merging.own_link(b))
    good = {k: v for k, v in (a["metadata"] or {}).items() if v}
    out["metadata"] = (a["metadata"] or {}) | {k: v for k, v in (b["metadata"] or {}).items() if v and k not in good}
    return out | ({"es_gratis": out["precio"] == 0} if out["precio"] is not None else {})


def plain_exact(group):
    """E1. A group's records, one after the other."""
    first = group[0]
    out = first | {"fuentes_relacionadas": plain_once([first["fuente"]]), "ids_relacionados": plain_once(plain_ids(first)), "source_links": plain_links(first["source_links"], merging.own_link(first))}
    for r in group[1:]:
        out = pair(out, r) | {"_ord": out["_ord"]}
    return out


def plain_editions(group, today):
    """E7. Editions of one plan."""
    by_day = sorted(group, key=lambda r: r["fecha_inicio"] or "")
    base = next((r for r in by_day if (r["fecha_inicio"] or "") >= today), by_day[0])
    out, times = base, {}
    for r in by_day:
        out = out if r is base else pair(out, r)
        times |= {s["datetime"] or s["fecha"]: s for s in r["sesiones"] or []}
        if r["fecha_inicio"]:
            at = r["datetime_inicio"] if r["tiene_hora_inicio"] and r["datetime_inicio"] else None
            times.setdefault(at or r["fecha_inicio"], {"fecha": r["fecha_inicio"], "datetime": at, "tiene_hora": bool(at)})
    told = [times[k] for k in sorted(times)]
    days, ahead = sorted({s["fecha"] for s in told}), [s for s in told if s["fecha"] >= today]
    ends = [r["fecha_fin"] or r["fecha_inicio"] or "" for r in by_day] + days[-1:]
    out = out | {"sesiones": ahead or told[-1:], "fecha_inicio": (days or [out["fecha_inicio"]])[0], "fecha_fin": max(ends) or out["fecha_fin"]}
    out["fechas_disponibles"] = [s["datetime"] or s["fecha"] for s in out["sesiones"]]
    if len(days) > 2:
        out["modo_fecha"] = "multiple"
    if ahead:
        at = ahead[0]["datetime"]
        out |= {"proxima_fecha": ahead[0]["fecha"], "datetime_inicio": at, "tiene_hora_inicio": bool(at)}
    first, last = out["fecha_inicio"] or out["fecha_fin"], out["fecha_fin"] or out["fecha_inicio"]
    return out | {"estado_temporal": "sin_fecha" if not first else "pasado" if last < today else "en_curso" if first <= today else "proximo"}


def whole_days(rows, today):
    """The same-day and recurring merges by plain loops over all records in order, without groups."""
    days = {}
    done = [r for r in rows if not (tokens(r) and r["fecha_inicio"])]
    for r in rows:
        if tokens(r) and r["fecha_inicio"]:
            days.setdefault(r["fecha_inicio"], []).append(r)
    for group in days.values():
        held = []
        for r in sorted(group, key=lambda r: -len(tokens(r))):
            own = set(tokens(r))
            for k, (words, other) in enumerate(held):
                if own <= words and (len(own) >= 3 or own == words) and folding.compatible(venue(other), venue(r)):
                    held[k] = (words, pair(other, r))
                    break
            else:
                held.append((own, r))
        done += [r for _, r in held]
    clusters, out = {}, []
    for r in done:
        key = tokens(r)
        if not key or not (venue(r) or len(key) >= 4):
            out.append([r])
            continue
        for members in clusters.setdefault(key, []):
            if all(folding.compatible(venue(m), venue(r)) for m in members):
                members.append(r)
                break
        else:
            clusters[key].append([r])
    out += [members for each in clusters.values() for members in each]
    return [members[0] if len(members) == 1 else plain_editions(members, today) for members in out]


#: Fields that plain_editions() leaves to the functions on dates.
LEFT = {"_ord", "id", "proximo_datetime", "sort_datetime", "vigente_hasta"}


def same(r):
    """All fields of a record, for comparison."""
    links = sorted(tuple(x.items()) for x in r["source_links"] or [])
    return {n: r[n] for n in r if n not in LEFT and not n.startswith("_") and n != "fuente"} | {"source_links": links, "sesiones": r["sesiones"] or [], "metadata": r["metadata"] or {}, **{n: r[n] or [] for n in ("categorias", "etiquetas", "fechas_disponibles")}}


def loose_records(r, n):
    """Records as the merge meets them, with all that it compares or fills in left out at times."""
    some = lambda *values: r.choice([None, *values])
    for k in range(n):
        yield {name: None for name in merging.KINDS} | {
            "_ord": k * 3,
            "fuente": r.choice(["fever", "wegow", "matadero", "datos_madrid", "unknown"]),
            "fuente_id": some(f"i{k}"),
            "titulo": f"t{k}",
            **{f: some("", f"{f}{k}") for f in ("url", "url_compra", "url_articulo", "imagen", "lugar", "direccion", "moneda", "publicado_en", "modo_fecha", "subtitulo")},
            **{f: some("", "x" * r.randint(0, 9), " y  z ") for f in ("contenido", "descripcion", "resumen")},
            "precio": some(0.0, 0.0, float(k)),
            "es_gratis": some(True, False),
            "latitud": some(0.0, 40.0 + k),
            "categorias": some([], ["A", "b"], ["B", f"c{k % 3}"]),
            "fechas_disponibles": some(["2024-01-20"]),
            "sesiones": some([], [{"fecha": "2024-01-20", "datetime": some("2024-01-20T20:00"), "tiene_hora": r.random() < 0.5}]),
            "metadata": some({}, {"k": "", "v": str(k)}, {"k": f"k{k}", "url_fuente_editorial": f"http://e/{k}"}),
            "source_links": some([], [{"fuente": "fever", "url": r.choice(["http://a", "http://a/", "http://b"]), "kind": r.choice(["compra", "detalle", None]), "precio": some(1.0), "moneda": some("EUR", ""), "es_gratis": some(True)}]),
        }


def measured(x):
    given = lambda v: v not in (None, "")
    return x | {"_rank": dims.SOURCE_PRIORITY.get(x["fuente"], dims.NO_PRIORITY), "_bits": sum(1 << k for k, n in enumerate(merging.COUNTED) if given(x[n])), "_clen": len(merging.clean(x["contenido"])), "_dlen": len(merging.clean(x["descripcion"]))}


def test_rules_match_records_merged_one_by_one():
    r = random.Random(8)
    for _ in range(400):
        group = list(loose_records(r, r.randint(2, 9)))
        got = merging.joined(merging.runs([measured(x) for x in group], Compat(), True), Compat())
        assert same({n: got[n] for n in merging.KINDS}) == same(plain_exact(group))


@pytest.mark.parametrize("span", [1 << 16, 7])
def test_groups_in_segments_match_records_merged_one_by_one(spark, monkeypatch, span):
    """Groups of one segment and of many; the same key, so all of one group."""
    monkeypatch.setattr(merging, "SPAN", span)
    r = random.Random(9)
    groups = {"a": list(loose_records(r, 60)), "b": list(loose_records(r, 3)), "c": sorted(loose_records(r, 40), key=lambda x: (-dims.SOURCE_PRIORITY.get(x["fuente"], 99), len(x["contenido"] or "")))}
    rows = []
    for key, group in groups.items():
        for k, x in enumerate(group):
            x["_ord"] = k * 2
            rows.append({**x, "_key": key, "_n": len(group), "_place": [k * 2]})
    ddl = schema.PLAN + ", _key string, _n long, _place array<long>"
    names = [*schema.fields(schema.PLAN), "_key", "_n", "_place"]
    df = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], ddl).repartition(5)
    got = {x._key: x.asDict(recursive=True) for x in merging.merged(df, "_key", 60, opens=True).collect()}
    assert set(got) == set(groups)
    for key, group in groups.items():
        assert same({n: got[key][n] for n in merging.KINDS}) == same(plain_exact(group)) and got[key]["_ord"] == 0


@pytest.mark.parametrize("seed, span", [(0, 1 << 16), (1, 1 << 16), (1, 3)])
def test_merges_match_plain_loops(spark, sf_dir, monkeypatch, seed, span):
    """All fields, over the whole fixture, and over records made to meet often, in groups of one segment and of many."""
    monkeypatch.setattr(merging, "SPAN", span)
    r = random.Random(seed)
    if seed:
        words = "gran concierto de jazz noche flamenco taller danza museo".split()
        places = ["Sala Uno", "Sala Uno Planta Dos", None, "Madrid", "Teatro"]
        plans = canonical(spark, [plan(r.choice(["fever", "wegow", "meetup", "matadero"]), " ".join(r.sample(words, r.randint(2, 5))), f"2024-01-{r.randint(18, 21)}" if r.random() < 0.9 else None, r.choice(places), id=str(k), descripcion="x" * r.randint(0, 9), precio=str(r.randint(0, 3))) for k in range(150)])
    else:
        plans = kept(fixtures.plans(spark, sf_dir))
    exact = kept(resolve.merge_exact(plans))
    rows = []
    for row in exact.orderBy("_ord").collect():
        x = row.asDict(recursive=True)
        rows.append(x)
    expected = sorted((same(x) for x in whole_days(rows, TODAY)), key=lambda x: str((x["ids_relacionados"], x)))
    merged = resolve.merge_plans(plans, TODAY)
    got = sorted((same({n: v for n, v in x.asDict(recursive=True).items()}) for x in merged.collect()), key=lambda x: str((x["ids_relacionados"], x)))
    for one, other in zip(got, expected, strict=True):
        assert {n: one[n] for n in other if n != "fuentes_relacionadas"} == {n: v for n, v in other.items() if n != "fuentes_relacionadas"}
    assert len(got) < len(rows)
    ranked = [x.id for x in discover.with_rank(kept(merged), discover.plan_order()).orderBy("rank").collect()]
    assert ranked == [x.id for x in merged.collect()]


def test_compat_switches(spark):
    off = Compat(**{f: False for f in Compat.__dataclass_fields__})
    plans = canonical(
        spark,
        [
            plan("meetup", "Gran concierto de jazz", "2024-01-20", "Sala Uno", url="https://s/1", precio="5", id="a"),
            plan("fever", "Gran concierto de jazz", "2024-01-20", "Sala Uno", url="https://s/1", precio="0", id="b"),
            plan("fever", "Taller de danza clásica", "2024-01-20", "Teatro", id="c"),
            plan("fever", "Taller de danza clásica", "2024-01-22", "Teatro", id="d"),
            plan("fever", "Algo que ya fue hace tiempo", "2023-01-20", "Teatro", id="e"),
        ],
    )
    kept_, fixed = ({r.titulo: r for r in resolve.merge_plans(plans, TODAY, c).collect()} for c in (Compat(), off))
    assert len(kept_) == 3 and len(fixed) == 2
    jazz = "Gran concierto de jazz"
    assert (kept_[jazz].precio, fixed[jazz].precio) == (5.0, 0.0)
    assert ({x.fuente for x in kept_[jazz].source_links}, {x.fuente for x in fixed[jazz].source_links}) == ({"meetup"}, {"meetup", "fever"})
    assert (kept_["Taller de danza clásica"].modo_fecha, fixed["Taller de danza clásica"].modo_fecha) == ("puntual", "multiple")
    blob = spark.createDataFrame([("musica en el jardin", "Chamberí", "ftp://a")], "blob string, label string, u string")
    link = F.struct(F.lit("f").alias("fuente"), F.col("u").alias("url"), F.lit("").alias("kind"), F.lit(1.0).alias("precio"), F.lit("").alias("moneda"), F.lit(True).alias("es_gratis"))
    good = F.struct(F.lit("f").alias("fuente"), F.lit("http://b").alias("url"), F.lit("").alias("kind"), F.lit(1.0).alias("precio"), F.lit("").alias("moneda"), F.lit(True).alias("es_gratis"))
    nothing = F.lit(None).cast("double")
    for c, expected in ((Compat(), (0, True, 0)), (off, (2, False, 6))):
        row = blob.select(discover.hits(F.col("blob"), ["música", "jardín"], c), predicates.in_zone("Nowhere", nothing, nothing, "label", c), F.size(arrays.slim_links(F.concat(F.array(*[link] * 6), F.array(*[good] * 7)), c))).first()
        assert tuple(row) == expected
    keys = spark.createDataFrame([("x",)], "cache_key string")
    assert [enrich.resolve_addresses(keys, lambda k: None, c).count() for c in (Compat(), off)] == [1, 0]


@pytest.mark.parametrize("most", [None, 12])
def test_diversify_matches_a_plain_loop(spark, most):
    r = random.Random(3)
    for kinds in (["A"] * 48 + ["B"] * 12, [r.choice("AAAB") for _ in range(90)], ["A"] * 20, []):
        waiting, out = list(enumerate(kinds, 1)), []
        while waiting:
            last = [k for _, k in out[-2:]]
            k = next((i for i, (_, kind) in enumerate(waiting) if not (len(last) == 2 and last[0] == last[1] == kind)), 0)
            out.append(waiting.pop(k))
        df = spark.createDataFrame(list(enumerate(kinds, 1)), "rank int, primary_category string")
        got = [(x.rank, x.primary_category) for x in discover.diversify(df, most).orderBy("place").collect()]
        assert got == out[:most]


@pytest.mark.parametrize("state, count", [(discover.State(query="jazz SALÁ"), 1), (discover.State(free_only=True), 1), (discover.State(zone="Retiro"), 0), (discover.State(date_filter="weekend"), 1), (discover.State(source="fever"), 2)])
def test_discover(spark, state, count):
    plans = canonical(spark, [plan("fever", "Noche de jazz", "2024-01-20T21:00", "Sala Sol", id="1", precio="10"), plan("fever", "Taller infantil", "2024-01-16", "Casa", id="2", precio="0")])
    view = discover.view_events(enrich.classify(plans), now())
    assert discover.discover(view, state).count() == count
