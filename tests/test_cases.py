"""Cases spelled out, against the values they must have."""

import duckdb
import pytest
from pyspark.sql import Window as W, functions as F

from folioscope.functions import text as T
from folioscope.operators import glossary, ledger, reading
from folioscope.queries import GLOSSARY, PRICES, duck, values

CASES: dict = {}


def case(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


ALIASES = "(VALUES ('g1','source','a'),('g1','source','an'),('g1','target','den'),('g2','target','vom'),('g2','source','off'),('g5','target','samt'),('g7','source','of')) AS a(entry_id, side, text)"
MODELS = "(VALUES ('gpt'),('gpt-large-2024-05-01'),('gpt-large-mini-x'),('gpt-x'),('ada-002'),('other')) AS m(model)"
STRINGS = r"""(VALUES (1,'1999'),(2,'c. 1840'),(3,'1914-1918'),(4,'The 1990s'),(5,'1990s'),(6,'44 BC'),(7,'House of Lords'),(8,'a very long phrase that has far more than ten words in its text'),
 (9,'Wait. What now'),(10,'open (bracket'),(11,'[[T0]][[/T0]]'),(12,'  '),(13,'[[T1]] x'),(14,'FIFA ('),(15,'  House Lannister  '),(16,'Heavily Indebted Poor Country (HIPC) initiative'),
 (17,'the the cat'),(18,'Of, of course'),(19,'the House'),(20,'an  apple pie'),(21,'theatre'),(22,'— So he said'),(23,'"Yes" she said'),(24,'plain prose'),(25,'“quoted”'),(26,'1h2m3s'),(27,'250ms'),(28,'90'),
 (29,'http://localhost:8080/x'),(30,'http://192.168.1.7/'),(31,'https://example.com/a'),(32,'http://printer.local'),(33,'http://10.0.0.3:99'),(34,'img/a.PNG'),(35,'x.css'),(36,'none'),
 (37,'Round Table Society'),(38,'Acme Company  Limited.'),(39,'Program'),(40,'Trade Agency'),(41,'Stop!'),(42,'(1066)'),(43,'1066 d.C.'),(44,'circa 1905'),(45,'Order 66'),(46,'‘Come in,’ he said'),(47,'12345'),(48,'b.avif')) AS s(id, s)"""

PLACED = "(VALUES (1,'[[T0]]a[[/T0]] [[T1]]'),(2,'[[T0]]a [[T1]]'),(3,'[[T0]]a[[/T0]]'),(4,'[[T0]]a[[/T0]][[T1]][[T1]]'),(5,'[[T0]][[/T0]][[T1]][[T7]]')) AS p(id, t)"
RANK = "CASE status WHEN 'locked' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'proposed' THEN 2 ELSE 99 END"


def _json(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"' END"""


def _json_list(side: str) -> str:
    return f"""'[' || coalesce((SELECT string_agg({_json('a.text')}, ', ' ORDER BY a.text) FROM {ALIASES} WHERE a.entry_id = g.id AND a.side = '{side}'), '') || ']'"""


@case("""SELECT * FROM (VALUES ('of the mist','en',NULL,'of the mist'),('the House','en','the','House'),('“the” House','en',NULL,'“the” House'),('(The) House','en','the','House'),('the','en',NULL,'the'),
 ('à la carte','fr-CA','à','la carte'),('pelas ruas','pt_BR','pelas','ruas'),('e depois','pt',NULL,'e depois'),('sugli alberi','it','sugli','alberi'),('Beim Haus','DE','beim','Haus'),('the sea','xx','the','sea')) AS t(term, lang, particle, stripped)""")
def particle_cases(spark, d):
    rows = values(spark, "(VALUES ('of the mist','en'),('the House','en'),('“the” House','en'),('(The) House','en'),('the','en'),('à la carte','fr-CA'),('pelas ruas','pt_BR'),('e depois','pt'),('sugli alberi','it'),('Beim Haus','DE'),('the sea','xx')) AS t(term, lang)")
    return rows.select("term", "lang", T.leading_particle(F.col("term"), F.col("lang")).alias("particle"), T.strip_particle(F.col("term"), F.col("lang")).alias("stripped"))


@case("""SELECT * FROM (VALUES (1,true),(2,true),(3,false),(4,true)) AS t(id, is_symmetric)""")
def particle_symmetry(spark, d):
    rows = values(spark, "(VALUES (1,'the House','o Lar'),(2,'House','Lar'),(3,'House','a Casa'),(4,'of Rome','Roma')) AS t(id, s, t)")
    return rows.select("id", T.symmetric(F.col("s"), F.lit("en"), F.col("t"), F.lit("pt")).alias("is_symmetric"))


@case("SELECT * FROM (VALUES (7,'house of lords'),(14,'fifa'),(15,'house lannister'),(16,'heavily indebted poor country'),(37,'round table'),(38,'acme'),(39,'program'),(40,'trade agency')) AS t(id, canon)")
def canonical_terms(spark, d):
    return values(spark, STRINGS).where("id in (7, 14, 15, 16, 37, 38, 39, 40)").select("id", T.canonical(T.nfkc(F.col("s"))).alias("canon"))


@case("SELECT * FROM (VALUES (1,true),(2,true),(3,true),(4,false),(5,true),(6,true),(7,false),(24,false),(42,true),(43,true),(44,true),(45,false),(47,false)) AS t(id, is_year)")
def year_like(spark, d):
    return values(spark, STRINGS).where("id in (1,2,3,4,5,6,7,24,42,43,44,45,47)").select("id", T.year_like(F.col("s")).alias("is_year"))


@case("SELECT * FROM (VALUES (1,'year'),(7,NULL),(8,'too_many_words'),(9,'sentence'),(10,'unbalanced'),(24,NULL),(41,'sentence')) AS t(id, why)")
def extractor_caps(spark, d):
    return values(spark, STRINGS).where("id in (1,7,8,9,10,24,41)").select("id", T.cap_violation(F.col("s")).alias("why"))


@case(f"SELECT id, trim(regexp_replace(s, '\\[\\[/?T\\d+\\]\\]', '', 'g')) = '' AS empty FROM {STRINGS}")
def trivially_empty(spark, d):
    return values(spark, STRINGS).select("id", T.trivially_empty(F.col("s")).alias("empty"))


@case("SELECT * FROM (VALUES (1,NULL),(2,'missing:/T0'),(3,'missing:T1'),(4,'repeated'),(5,'unknown:T7')) AS t(id, error)")
def placeholder_check(spark, d):
    return values(spark, PLACED).select("id", T.placeholder_error(F.col("t"), F.array(F.lit("pair"), F.lit("void"))).alias("error"))


@case("SELECT * FROM (VALUES (26,3723000),(27,250),(28,90000),(36,NULL)) AS t(id, ms)".replace("3723000", "3723000::BIGINT"))
def rate_limit_durations(spark, d):
    return values(spark, STRINGS).where("id in (26,27,28,36)").select("id", T.duration_ms(F.col("s")).alias("ms"))


@case("SELECT * FROM (VALUES (29,'loopback'),(30,'local'),(31,NULL),(32,'local'),(33,'local'),(36,NULL)) AS t(id, space)")
def address_space(spark, d):
    return values(spark, STRINGS).where("id in (29,30,31,32,33,36)").select("id", T.address_space(F.col("s")).alias("space"))


@case("SELECT * FROM (VALUES (34,'image/png','OEBPS/img/a.PNG'),(35,'application/octet-stream','OEBPS/x.css'),(36,'application/octet-stream','OEBPS/none'),(48,'image/avif','OEBPS/b.avif')) AS t(id, mime, path)")
def mime_and_path(spark, d):
    base = F.lit("OEBPS/text/../ch1.xhtml")
    return values(spark, STRINGS).where("id in (34,35,36,48)").select("id", T.mime(F.col("s")).alias("mime"), T.resolve_path(base, F.concat(F.lit("./"), "s")).alias("path"))


@case(f"SELECT id, source_term, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, source_term, id) AS place FROM {duck(GLOSSARY)} WHERE status <> 'proposed' AND source_term IS NOT NULL")
def glossary_constraints(spark, d):
    return glossary.constraints(values(spark, GLOSSARY)).select("id", "source_term", "place")


@case(f"SELECT id, target_term, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, target_term, id) AS place FROM {duck(GLOSSARY)} WHERE status <> 'proposed' AND source_term IS NULL")
def target_only_terms(spark, d):
    return glossary.target_only(values(spark, GLOSSARY)).select("id", "target_term", "place")


@case(f"""SELECT id, source_term, target_term FROM (SELECT *, CASE WHEN project_id = 'p1' THEN 0 ELSE 1 END AS tier, CASE WHEN project_id = 'p1' THEN 0 ELSE created_at END AS priority FROM {duck(GLOSSARY)}
 WHERE project_id = 'p1' OR status <> 'proposed') QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_term IS NOT NULL THEN type || '::' || lower(source_term) ELSE 'target::' || lower(target_term) END
 ORDER BY tier, priority DESC, coalesce(source_term, target_term), id) = 1""")
def priority_union(spark, d):
    g = values(spark, GLOSSARY)
    return glossary.merged_books(g.where("project_id = 'p1'"), g.where("project_id = 'p2'").withColumn("priority", F.col("created_at"))).select("id", "source_term", "target_term")


@case(f"""SELECT g.id, list_sort(coalesce(list(a.text) FILTER (a.side = 'source'), []::VARCHAR[])) AS source_aliases, list_sort(coalesce(list(a.text) FILTER (a.side = 'target'), []::VARCHAR[])) AS target_aliases
 FROM {duck(GLOSSARY)} LEFT JOIN {ALIASES} ON g.id = a.entry_id GROUP BY g.id""")
def alias_rollup(spark, d):
    return glossary.with_aliases(values(spark, GLOSSARY), values(spark, ALIASES)).select("id", "source_aliases", "target_aliases")


@case("SELECT project_id, left(sha256('[' || string_agg(item, ', ' ORDER BY coalesce(source_term, ''), target_term, id) || ']'), 32) AS glossary_hash FROM (SELECT *, '{' || " + " || ', ' || ".join(
    f"""'"{n}": ' || {v}""" for n, v in (("gender", _json("gender")), ("notes", _json("notes")), ("source_aliases", _json_list("source")), ("source_known", "CAST(source_known AS VARCHAR)"), ("source_term", _json("source_term")),
    ("status", _json("status")), ("target_aliases", _json_list("target")), ("target_term", _json("target_term")), ("type", _json("type")))) + f" || '}}' AS item FROM {duck(GLOSSARY)}) GROUP BY project_id")
def glossary_hash(spark, d):
    return glossary.glossary_hash(glossary.with_aliases(values(spark, GLOSSARY), values(spark, ALIASES)).orderBy(F.desc("id")))


@case(f"""SELECT DISTINCT w.winner_id, x.alias FROM (VALUES ('g1','g9'),('g1','g6'),('g2','g7')) AS w(winner_id, loser_id) JOIN
 (SELECT g.id, g.source_term AS alias FROM {duck(GLOSSARY)} WHERE g.source_term IS NOT NULL UNION SELECT a.entry_id, a.text FROM {ALIASES} WHERE a.side = 'source') x ON x.id = w.loser_id
 WHERE NOT EXISTS (SELECT 1 FROM (SELECT g.id, g.source_term AS alias FROM {duck(GLOSSARY)} UNION SELECT a.entry_id, a.text FROM {ALIASES} WHERE a.side = 'source') o WHERE o.id = w.winner_id AND o.alias = x.alias)""")
def merge_entries(spark, d):
    e = glossary.with_aliases(values(spark, GLOSSARY), values(spark, ALIASES))
    return glossary.merge_entries(e, values(spark, "(VALUES ('g1','g9'),('g1','g6'),('g2','g7')) AS w(winner_id, loser_id)"))


@case("SELECT * FROM (VALUES ('gpt','gpt'),('gpt-large-2024-05-01','gpt-large'),('gpt-large-mini-x','gpt-large'),('gpt-x','gpt'),('ada-002','ada'),('other',NULL)) AS t(model, matched)")
def price_prefix(spark, d):
    return ledger.priced(values(spark, MODELS), values(spark, PRICES)).select("model", "matched")


@case(f"SELECT id, row_number() OVER (ORDER BY coalesce(source_term, ''), id) AS place, row_number() OVER (ORDER BY coalesce(source_term, target_term), id) AS lore_place FROM {duck(GLOSSARY)}")
def glossary_list_order(spark, d):
    g = values(spark, GLOSSARY)
    place = lambda lore: F.row_number().over(W.orderBy(*reading.listed(g, lore))).cast("bigint")
    return g.select("id", place(False).alias("place"), place(True).alias("lore_place"))


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    f, sql = CASES[name]
    got, want = f(spark, None), duckdb.connect().execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: str(tuple(r))
    assert sorted(map(plain, got.select(*names).collect())) == sorted(map(plain, want.fetchall()))
