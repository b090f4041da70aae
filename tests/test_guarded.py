"""The guard as a security boundary: every payload that was ever thought of stays here."""

import os

import pytest

from tidemill.plans.guarded import GuardedSession
from tidemill.sinks.landing import save_table
from tidemill.sinks.models import create_view, drop_sandbox, materialize, sandbox_build, save_view
from tidemill.sources.catalog import create_database, table_exists

from conftest import rows

M, S = "zoo_marts.mart_longevity_by_class", "zoo_staging.stg_animals"

ATTACKS = {
    "drop": f"DROP TABLE {M}",
    "delete": f"DELETE FROM {M}",
    "update": f"UPDATE {S} SET class = 'x'",
    "insert": "INSERT INTO zoo_marts.x VALUES (1)",
    "create": "CREATE TABLE zoo_marts.evil AS SELECT 1",
    "alter": "ALTER TABLE zoo_marts.x ADD COLUMN y INT",
    "truncate": "TRUNCATE TABLE zoo_marts.x",
    "merge": f"MERGE INTO {M} USING {S} ON true WHEN MATCHED THEN DELETE",
    "multi_drop": f"SELECT 1; DROP TABLE {M}",
    "multi_trailing": f"SELECT * FROM {M}; DELETE FROM zoo_marts.x",
    "multi_set": "SET spark.sql.ansi.enabled=false; SELECT 1",
    "multi_insert": f"FROM {S} INSERT INTO zoo_marts.x SELECT * INSERT INTO zoo_marts.y SELECT *",
    "write_directory": f"INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT * FROM {M}",
    "file_text": "SELECT * FROM text.`/etc/passwd`",
    "file_csv": "SELECT * FROM csv.`/etc/passwd`",
    "file_parquet": "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "file_json": "SELECT * FROM json.`/secret.json`",
    "file_binary": "SELECT * FROM binaryFile.`/etc/hostname`",
    "file_nested": f"SELECT class FROM {M} WHERE class IN (SELECT value FROM text.`/etc/passwd`)",
    "file_join": f"SELECT * FROM {M} m JOIN csv.`/etc/passwd` f ON true",
    "read_files": "SELECT * FROM read_files('/etc/passwd')",
    "add_jar": "ADD JAR '/tmp/x.jar'",
    "add_file": "ADD FILE '/etc/passwd'",
    "set": "SET spark.sql.runSQLOnFiles=true",
    "reset": "RESET",
    "use": "USE evil",
    "cache": f"CACHE TABLE {M}",
    "explain": "EXPLAIN SELECT 1",
    "show": "SHOW TABLES",
    "describe": f"DESCRIBE {M}",
    "call": "CALL system.x()",
    "java_method": "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "reflect": "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "reflect_quoted": "SELECT `reflect`('java.lang.System', 'getenv', 'HOME')",
    "try_reflect": "SELECT try_reflect('java.lang.System', 'getenv', 'HOME')",
    "identifier": "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getenv', 'HOME')",
    "input_file_name": f"SELECT input_file_name() FROM {M}",
    "script": f"SELECT TRANSFORM(class) USING 'cat /etc/passwd' AS (x STRING) FROM {M}",
    "script_map": f"SELECT * FROM (FROM {M} MAP class USING 'cat' AS x)",
    "other_database": "SELECT * FROM hidden.secret",
    "other_database_nested": f"SELECT class FROM {M} WHERE n_species > (SELECT max(id) FROM hidden.secret)",
    "other_database_cte": f"WITH t AS (SELECT * FROM hidden.secret) SELECT * FROM {M} CROSS JOIN t",
    "other_database_exists": f"SELECT class FROM {M} m WHERE EXISTS (SELECT 1 FROM hidden.secret s WHERE s.id = m.n_species)",
    "closing_parenthesis": "SELECT 1 AS a) t CROSS JOIN (SELECT 2 AS b",
    "comment": "SELECT 1) x; DROP TABLE zoo_marts.x --",
    "unparsable": "SELECT FROM WHERE )(",
    "empty": "",
    "only_semicolon": " ; ",
}

LEGIT = {
    "simple": f"SELECT * FROM {M}",
    "projection": f"SELECT class, n_species FROM {M}",
    "join": f"SELECT s.species FROM {S} s JOIN {M} m ON s.class = m.class",
    "cte": f"WITH t AS (SELECT class FROM {M}) SELECT * FROM t",
    "union": f"SELECT class FROM {M} UNION SELECT class FROM {S}",
    "intersect": f"SELECT class FROM {M} INTERSECT SELECT class FROM {S}",
    "except": f"SELECT class FROM {M} EXCEPT SELECT species FROM {S}",
    "aggregate": f"SELECT class, COUNT(*) FROM {S} GROUP BY class HAVING COUNT(*) > 1",
    "subquery": f"SELECT * FROM {M} WHERE n_species > (SELECT AVG(n_species) FROM {M})",
    "in_subquery": f"SELECT * FROM {M} WHERE class IN (SELECT class FROM {S})",
    "scalar_func": f"SELECT upper(class), round(max_longevity, 1) FROM {M}",
    "trailing_semicolon": f"SELECT * FROM {M};",
    "trailing_comment": f"SELECT * FROM {M} -- all of it",
    "repeated_names": f"SELECT class, class FROM {M}",
    "values": "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)",
    "range": "SELECT * FROM range(3)",
    "series": "SELECT explode(sequence(1, 3)) AS i",
    "unnest": "SELECT * FROM explode(array(1, 2))",
    "higher_order": "SELECT transform(array(1, 2), x -> x + 1) AS a",
    "window": f"SELECT class, row_number() OVER (ORDER BY n_species DESC, class) AS r FROM {M}",
    "view": "SELECT * FROM zoo_staging.visible",
}


@pytest.fixture(scope="module")
def session(spark, zoo, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hidden"))
    create_database(spark, "hidden", root)
    save_table(spark.range(5), "hidden", "secret")
    # A view is the owner's choice of what to show.
    save_view(spark, zoo.staging, "visible", "SELECT id FROM hidden.secret WHERE id > 2")
    return GuardedSession(spark, [zoo.staging, zoo.marts])


@pytest.mark.parametrize("name", ATTACKS)
def test_attacks_are_refused(session, name):
    planned = session.plan(ATTACKS[name])
    assert planned.frame is None and planned.refusal.message, f"{name} was not refused"


@pytest.mark.parametrize("name", LEGIT)
def test_legitimate_queries_pass(session, name):
    outcome = session.run(LEGIT[name])
    assert outcome.ok, outcome.refusal
    assert outcome.provenance.row_count == len(outcome.rows) > 0 and not outcome.provenance.truncated


def test_temp_views_of_the_parent_are_not_visible(spark, session):
    create_view(spark.range(3), "parent_view")
    assert session.plan("SELECT * FROM parent_view").refusal.kind == "dry_run_not_passed"


@pytest.mark.parametrize(
    "sql, condition",
    [
        (f"SELECT nope FROM {M}", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        ("SELECT * FROM zoo_marts.nope", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT * FROM mart_longevity_by_class", "TABLE_OR_VIEW_NOT_FOUND"),
        (f"SELECT x.class FROM {M} m", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        (f"SELECT class FROM {M} JOIN {S}", "AMBIGUOUS_REFERENCE"),
    ],
)
def test_analysis_errors_are_data(session, sql, condition):
    refusal = session.run(sql).refusal
    assert (refusal.kind, refusal.message) == ("dry_run_not_passed", condition)


def test_kinds_of_refusal(session):
    assert session.run(ATTACKS["drop"]).refusal.kind == "non_read_only"
    assert session.run(ATTACKS["file_csv"]).refusal.kind == "non_read_only"
    assert session.run("SELECT 1 / (id - id) FROM range(2)").refusal.kind == "execution_error"


def test_row_cap(spark, zoo):
    session = GuardedSession(spark, [zoo.marts], row_cap=3)
    cut, exact = session.run("SELECT * FROM range(4)"), session.run("SELECT * FROM range(3)")
    assert (cut.provenance.row_count, cut.provenance.truncated) == (3, True)
    assert (exact.provenance.row_count, exact.provenance.truncated) == (3, False)


def test_capped_order(spark, zoo):
    session = GuardedSession(spark, [zoo.staging], row_cap=2)
    outcome = session.run(f"SELECT species FROM {S} ORDER BY longevity_yrs DESC")
    assert [r[0] for r in outcome.rows] == ["Rougheye rockfish", "Eastern box turtle"]


def test_timeout(spark, zoo):
    session = GuardedSession(spark, [zoo.marts], timeout_s=2)
    outcome = session.run("SELECT sum(sin(a.id) * cos(a.id)) FROM range(0, 1000000000000, 1, 8) a")
    assert outcome.refusal.kind == "execution_error"


def test_warnings(session):
    outcome = session.run("SELECT -1 AS n_items, date'2024-01-01' AS d, struct(1) AS s")
    assert outcome.ok and [w["kind"] for w in outcome.warnings] == ["negative_count"]
    assert [w["kind"] for w in session.run(f"SELECT * FROM {M} WHERE false").warnings] == ["empty_result"]


def test_chain(session):
    chain = session.chain(
        [
            f"SELECT class, max_longevity FROM {M} WHERE max_longevity > 100",
            f"SELECT s.species, s.longevity_yrs FROM {S} s JOIN hop_1_result h ON s.class = h.class",
            "SELECT count(*) AS n_species FROM hop_2_result h2 JOIN hop_1_result h1 ON h1.max_longevity = h2.longevity_yrs",
        ]
    )
    assert (chain.outcome, chain.display, rows(chain.frame)) == ("clean", 3, [(3,)])


def test_later_hops_see_more_than_the_cap(spark, zoo):
    session = GuardedSession(spark, [zoo.marts], row_cap=10)
    chain = session.chain(["SELECT id FROM range(5000)", "SELECT count(*) AS n_ids FROM hop_1_result"])
    assert chain.hops[0].provenance.truncated and rows(chain.frame) == [(5000,)]


def test_chain_stops_at_the_first_failure(session):
    chain = session.chain(["SELECT 1 AS a", "SELECT nope FROM hop_1_result", "SELECT 2 AS b"])
    assert (len(chain.hops), chain.display, chain.outcome) == (2, 1, "failed")
    assert session.chain(["DROP TABLE x"]).outcome == "refused"
    assert session.chain([]).outcome == "failed"
    assert session.chain(["SELECT -1 AS n_x"]).outcome == "flagged"
    assert len(session.chain(["SELECT 1 AS a"] * 5).hops) == 5


def test_a_chain_of_too_many_steps_is_refused_as_a_whole(session):
    chain = session.chain(["SELECT 1 AS a"] * 7)
    assert (chain.outcome, chain.display, chain.hops[0].refusal.kind) == ("refused", None, "too_many_steps")


def test_denied_names_may_be_columns_and_texts(session):
    outcome = session.run("SELECT 'to reflect' AS t, identifier FROM (SELECT 1 AS identifier) -- reflect(")
    assert outcome.ok and outcome.rows[0]["identifier"] == 1
    refused = session.run("WITH c AS (SELECT 1 AS x) SELECT x FROM c WHERE x IN (SELECT length(try_reflect('a', 'b')))")
    assert refused.refusal.kind == "non_read_only"


def test_all_rows_are_judged_and_columns_suggested(session):
    outcome = session.run("SELECT CASE WHEN id < 2000 THEN 1 ELSE -1 END AS n_x FROM range(3000)")
    assert [w["kind"] for w in outcome.warnings] == ["negative_count"]
    (name,) = session.run("SELECT valeu FROM (SELECT 1 AS value)").refusal.suggestions
    assert name.endswith("value")


def test_joins_that_repeat_rows_are_told(session):
    one = "SELECT * FROM VALUES (1, 10), (2, 20) AS t(k, v)"
    many = "SELECT * FROM VALUES (1, 5), (1, 6), (2, 7) AS t(k, w)"
    warned = lambda sql: sorted(w["column_name"] for w in session.run(sql).warnings if w["kind"] == "join_fanout")
    joined = f"FROM ({one}) a JOIN ({many}) b ON a.k = b.k"
    assert warned(f"SELECT sum(v) AS sv, sum(w) AS sw, count(*) AS c, count(DISTINCT a.k) AS d {joined}") == ["c", "sv"]
    assert warned(f"SELECT max(v) AS m, sum(w) AS sw {joined}") == []
    assert warned(f"SELECT sum(v) AS sv FROM ({one}) a JOIN (SELECT k, sum(w) AS w FROM ({many}) GROUP BY k) b ON a.k = b.k") == []
    assert warned(f"SELECT sum(v) AS sv FROM ({one}) a JOIN ({one}) b USING (k)") == []


def test_joins_that_repeat_rows_are_told_wherever_they_stand(session):
    one = "SELECT * FROM VALUES (1, 10), (2, 20) AS t(k, v)"
    many = "SELECT * FROM VALUES (1, 5), (1, 6), (2, 7) AS t(k, w)"
    joined = f"SELECT a.k, v, v + 1 AS more, w FROM ({one}) a JOIN ({many}) b ON a.k = b.k"
    warned = lambda sql: {w["column_name"]: w["high"] for w in session.run(sql).warnings if w["kind"] == "join_fanout"}
    assert warned(f"WITH j AS ({joined}) SELECT sum(more) AS s, sum(w) AS t FROM j") == {"s": 2.0}
    assert warned(f"WITH j AS ({joined}) SELECT sum(x.v) AS s FROM j x WHERE x.v > 0 UNION ALL SELECT count(*) AS c FROM j") == {"s": 2.0, "c": 2.0}
    assert warned(f"SELECT sum(v) AS s FROM ({joined} ORDER BY v)") == {"s": 2.0}
    assert warned(f"SELECT sum(v) AS s FROM (SELECT v, row_number() OVER (ORDER BY w) AS r FROM ({joined}))") == {"s": 2.0}
    assert warned(f"SELECT sum(x) AS s FROM (SELECT v AS x FROM ({joined}) UNION ALL SELECT w AS x FROM ({many}))") == {"s": 2.0}
    assert warned(f"SELECT sum(v) AS s, sum(w) AS t FROM ({one}) a CROSS JOIN ({many}) b") == {"s": 3.0, "t": 2.0}
    assert warned(f"SELECT sum(v) AS s FROM ({one}) a CROSS JOIN (SELECT max(w) AS m FROM ({many})) b") == {}
    assert warned(f"WITH j AS (SELECT DISTINCT k, v FROM ({joined})) SELECT sum(v) AS s FROM j") == {}


def test_a_query_runs_once_and_later_hops_read_what_it_wrote(spark, zoo):
    session = GuardedSession(spark, [zoo.marts])
    chain = session.chain(["SELECT id, rand() AS x FROM range(50)", "SELECT id, x, NULL AS none FROM hop_1_result ORDER BY x DESC", "SELECT max(x) AS m FROM hop_2_result"])
    first, second, third = ({r["id"]: r["x"] for r in h.rows} if "id" in h.frame.columns else h.rows for h in chain.hops)
    assert first == second == {r["id"]: r["x"] for r in chain.hops[0].frame.collect()} and third[0]["m"] == max(first.values())
    assert [r["x"] for r in chain.hops[1].frame.collect()] == sorted(first.values(), reverse=True)
    assert chain.hops[1].frame.dtypes[2] == ("none", "void")
    written = list(session.results.paths)
    session.close()
    assert len(written) == 3 and not any(os.path.exists(p.removeprefix("file:")) for p in written)


def test_empty_results_are_not_registered(session):
    chain = session.chain(["SELECT 1 AS a WHERE false", "SELECT * FROM hop_1_result"])
    assert chain.outcome == "failed" and len(chain.hops) == 2


def test_turns(spark, zoo):
    session = GuardedSession(spark, list(zoo.databases))
    session.turn([f"SELECT class FROM {S}", "SELECT class, count(*) AS n_rows FROM hop_1_result GROUP BY class"])
    second = session.turn(["SELECT class FROM turn_1_result WHERE n_rows > 1"])
    assert rows(second.frame) == [("Mammalia",)]
    assert session.run("SELECT * FROM hop_1_result").refusal is not None
    session.turn(["SELECT 1 AS a WHERE false"])
    assert session.run("SELECT * FROM turn_3_result").refusal is not None
    assert rows(session.turn(["SELECT * FROM turn_2_result"]).frame) == [("Mammalia",)]


def test_display_hop(session):
    steps = ["SELECT 1 AS a", "SELECT 2 AS b"]
    assert session.chain(steps, display=1).frame.columns == ["a"]
    assert session.chain(steps, display=9).display == 2


def test_sandbox(spark, session, zoo, tmp_path):
    root = str(tmp_path)
    built = sandbox_build(session, "mart_x", f"SELECT class, n_species FROM {M}", sample_limit=2, root=root)
    assert built.refusal is None and built.rows == 4 and built.sample.count() == 2 and built.oddities == ()
    assert built.table.dtypes == [("class", "string"), ("n_species", "bigint")]
    assert table_exists(spark, "_sandbox", "mart_x")
    assert materialize(spark.table("_sandbox.mart_x"), zoo.marts, "mart_x") == 4
    assert not table_exists(spark, "_sandbox", "mart_x") and spark.table("zoo_marts.mart_x").count() == 4
    spark.sql("DROP TABLE zoo_marts.mart_x")
    drop_sandbox(spark, "never_built")


@pytest.mark.parametrize(
    "sql, warnings",
    [
        (f"SELECT * FROM {M} WHERE false", ["zero_rows"]),
        (f"SELECT count(*) AS n FROM {M}", ["one_row"]),
        (f"SELECT class, Class FROM {M}", ["duplicate_columns"]),
    ],
)
def test_sandbox_warnings(session, tmp_path, sql, warnings):
    built = sandbox_build(session, "mart_w", sql, root=str(tmp_path))
    assert built.refusal is None and list(built.oddities) == warnings


def test_sandbox_refuses_writes(session, tmp_path):
    built = sandbox_build(session, "mart_bad", f"DROP TABLE {M}", root=str(tmp_path))
    assert built.table is None and built.refusal.kind == "non_read_only"
