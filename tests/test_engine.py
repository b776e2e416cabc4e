import pytest

from strandline import jobs, security
from strandline.engine import Engine, Settings
from strandline.operators.dml import ConstraintError
from strandline.operators.transactions import TransactionError
from strandline.plans.tokens import SqlError
from strandline.sources.catalog import AlreadyExists, CatalogError, NotFound


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


@pytest.fixture()
def root(engine):
    s = engine.session()
    s.sql("CREATE NAMESPACE app; USE app")
    return s


def rows(df, *names):
    return [tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()]


def employees(s):
    s.sql("CREATE SHARED TABLE emp (id INT PRIMARY KEY, name TEXT NOT NULL, dept TEXT DEFAULT 'none', salary INT)")
    s.sql("INSERT INTO emp VALUES (1,'Alice','Eng',100000),(2,'Bob','Eng',90000),(3,'Charlie','Sales',80000)")


def test_insert_update_delete_and_default_order(root):
    employees(root)
    assert rows(root.sql("SELECT id, name FROM emp"), "id", "name") == [(1, "Alice"), (2, "Bob"), (3, "Charlie")]
    assert root.sql("INSERT INTO emp (id, name) VALUES (0, 'It''s')").first().rows_affected == 1
    assert rows(root.sql("SELECT name, dept, salary FROM emp WHERE id = 0")) == [("It's", "none", None)]
    assert root.sql("UPDATE emp SET salary = salary * 2, dept = 'X' WHERE dept = 'Eng'").first().rows_affected == 2
    assert root.sql("DELETE FROM emp WHERE id = $1", [3]).first().rows_affected == 1
    assert rows(root.sql("SELECT id, salary FROM app.emp e WHERE e.salary IS NOT NULL")) == [(1, 200000), (2, 180000)]
    assert rows(root.sql("SELECT id FROM emp ORDER BY salary DESC NULLS LAST LIMIT 2")) == [(1,), (2,)]
    assert rows(root.sql("SELECT emp.id FROM emp WHERE _deleted = true")) == [(3,)]
    assert rows(root.sql("WITH t AS (SELECT dept, count(*) n FROM emp GROUP BY dept) SELECT n FROM t ORDER BY dept")) == [(2,), (1,)]
    assert root.sql("SELECT * FROM emp").columns == ["id", "name", "dept", "salary", "_seq", "_deleted"]


def test_constraints(root):
    employees(root)
    for bad in ("INSERT INTO emp VALUES (1,'again','x',1)", "INSERT INTO emp VALUES (7,'a','x',1),(7,'b','x',1)", "INSERT INTO emp (id, nope) VALUES (9, 1)"):
        with pytest.raises(ConstraintError):
            root.sql(bad)
    with pytest.raises(Exception, match="may not be null"):
        root.sql("INSERT INTO emp (id, dept) VALUES (9, 'x')")
    with pytest.raises(ConstraintError):
        root.sql("UPDATE emp SET id = 5 WHERE id = 1")
    with pytest.raises(SqlError):
        root.sql("DELETE FROM emp")
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE t (a INT PRIMARY KEY, A TEXT)", "CREATE TABLE t (_seq INT PRIMARY KEY)"):
        with pytest.raises(CatalogError):
            root.sql(bad)
    with pytest.raises(SqlError):
        root.sql("CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))")
    with pytest.raises(NotFound):
        root.sql("SELECT * FROM app.nothing_here")


def test_returning_and_generated_keys(root):
    root.sql("CREATE SHARED TABLE ev (id BIGINT PRIMARY KEY DEFAULT SNOWFLAKE_ID(), u TEXT DEFAULT UUID_V7(), l TEXT DEFAULT ULID(), by TEXT DEFAULT CURRENT_USER(), v INT)")
    seqs = rows(root.sql("INSERT INTO ev (v) VALUES (1), (2), (3) RETURNING _seq"))
    assert len(set(seqs)) == 3
    got = root.sql("SELECT * FROM ev").collect()
    assert len({r.id for r in got}) == 3 and len({r.u for r in got}) == 3 and all(len(r.l) == 26 and r.u[14] == "7" and r.by == "root" for r in got)


def test_user_tables_are_private_rows(engine, root):
    root.sql("CREATE USER TABLE notes (id INT PRIMARY KEY, body TEXT)")
    ann, bob, service = engine.session("ann", "user", "app"), engine.session("bob", "user", "app"), engine.session("svc", "service", "app")
    ann.sql("INSERT INTO notes VALUES (1, 'a1'), (2, 'a2')")
    bob.sql("INSERT INTO notes VALUES (1, 'b1')")
    assert rows(ann.sql("SELECT id, body FROM notes")) == [(1, "a1"), (2, "a2")]
    assert rows(bob.sql("SELECT body FROM notes")) == [("b1",)]
    assert sorted(rows(service.sql("SELECT _user_id, body FROM notes"))) == [("ann", "a1"), ("ann", "a2"), ("bob", "b1")]
    assert ann.sql("DELETE FROM notes WHERE id = 1").first().rows_affected == 1
    assert rows(bob.sql("SELECT count(*) AS n FROM notes")) == [(1,)]
    assert rows(service.sql("EXECUTE AS USER 'bob' (SELECT body FROM notes WHERE id = 1)")) == [("b1",)]
    with pytest.raises(security.AccessDenied):
        ann.sql("EXECUTE AS USER 'bob' (SELECT 1)")


def test_shared_access_levels(engine, root):
    employees(root)
    user = engine.session("u", "user", "app")
    for text in ("SELECT * FROM emp", "INSERT INTO emp VALUES (9,'x','y',1)", "CREATE NAMESPACE x", "SELECT * FROM system.users", "STORAGE FLUSH TABLE emp"):
        with pytest.raises(security.AccessDenied):
            user.sql(text)
    root.sql("ALTER TABLE emp SET ACCESS LEVEL public")
    assert rows(user.sql("SELECT count(*) FROM emp")) == [(3,)]
    with pytest.raises(security.AccessDenied):
        user.sql("DELETE FROM emp WHERE id = 1")
    user.sql("CREATE SHARED TABLE mine (id INT PRIMARY KEY)")
    assert engine.catalog.table("app.mine").kind == "USER"


def test_transactions(engine, root):
    employees(root)
    other = engine.session("x", "system", "app")
    root.sql("BEGIN")
    root.sql("INSERT INTO emp VALUES (10,'Ten','T',1); INSERT INTO emp VALUES (11,'Eleven','T',2)")
    root.sql("UPDATE emp SET salary = 5 WHERE id = 10")
    root.sql("DELETE FROM emp WHERE id = 2")
    root.sql("UPDATE emp SET dept = 'Q' WHERE id = 1")
    assert rows(root.sql("SELECT id, dept, salary FROM emp ORDER BY id")) == [(1, "Q", 100000), (3, "Sales", 80000), (10, "T", 5), (11, "T", 2)]
    assert rows(other.sql("SELECT count(*) FROM emp")) == [(3,)]
    other.sql("UPDATE emp SET salary = 1 WHERE id = 3")
    assert rows(root.sql("SELECT salary FROM emp WHERE id = 3")) == [(80000,)]
    with pytest.raises(TransactionError):
        root.sql("CREATE TABLE t (a INT PRIMARY KEY)")
    with pytest.raises(TransactionError):
        root.sql("BEGIN")
    root.sql("COMMIT")
    assert rows(other.sql("SELECT id, dept, salary FROM emp ORDER BY id")) == [(1, "Q", 100000), (3, "Sales", 1), (10, "T", 5), (11, "T", 2)]
    root.sql("START TRANSACTION; DELETE FROM emp WHERE id > 0; ROLLBACK")
    assert rows(root.sql("SELECT count(*) FROM emp")) == [(4,)]
    with pytest.raises(TransactionError):
        root.sql("COMMIT")


def test_flush_compact_and_snapshots(engine, root):
    employees(root)
    table = engine.catalog.table("app.emp")
    before = engine.log(table).manifest().last_commit
    root.sql("UPDATE emp SET salary = 1 WHERE id = 1; DELETE FROM emp WHERE id = 2")
    root.sql("STORAGE FLUSH TABLE emp")
    log = engine.log(table)
    assert [s.tier for s in log.manifest().segments] == ["cold"] and log.manifest().segments[0].tombstones == 1
    root.sql("INSERT INTO emp VALUES (4,'Dan','Ops',7)")
    assert rows(root.sql("SELECT id, salary FROM emp")) == [(1, 1), (3, 80000), (4, 7)]
    assert sorted(r.id for r in log.current(snapshot=before).collect()) == [3]
    root.sql("STORAGE COMPACT TABLE emp")
    assert [(s.tier, s.rows, s.tombstones) for s in log.manifest().segments] == [("cold", 3, 0)]
    assert rows(root.sql("SELECT id FROM emp")) == [(1,), (3,), (4,)]
    assert [len(log.choose(pk=k)) for k in (3, 99)] == [1, 0]
    assert {j.job_type for j in root.sql("SELECT * FROM system.jobs").collect()} == {"flush", "compact"}


def test_flush_policy_and_retention(engine, root):
    root.sql("CREATE SHARED TABLE p (id INT PRIMARY KEY) WITH (FLUSH_POLICY = 'rows:3', DELETED_RETENTION_HOURS = 1)")
    root.sql("INSERT INTO p VALUES (1), (2)")
    table = engine.catalog.table("app.p")
    assert engine.log(table).manifest().segments[0].tier == "hot"
    root.sql("INSERT INTO p VALUES (3)")
    assert [s.tier for s in engine.log(table).manifest().segments] == ["cold"]
    root.sql("DELETE FROM p WHERE id = 1")
    assert jobs.retention(engine, table) == 3 and jobs.retention(engine, table, 4_000_000_000_000) == 2


def test_schema_changes(root, engine):
    employees(root)
    root.sql("ALTER TABLE emp ADD COLUMN age SMALLINT")
    root.sql("ALTER TABLE emp RENAME COLUMN dept TO team")
    root.sql("ALTER TABLE emp MODIFY COLUMN salary BIGINT")
    root.sql("INSERT INTO emp VALUES (4,'Dan','Ops',7,33)")
    assert rows(root.sql("SELECT id, team, salary, age FROM emp ORDER BY id")) == [(1, "Eng", 100000, None), (2, "Eng", 90000, None), (3, "Sales", 80000, None), (4, "Ops", 7, 33)]
    assert root.sql("SELECT salary FROM emp").schema[0].dataType.simpleString() == "bigint"
    root.sql("ALTER TABLE emp DROP COLUMN team; ALTER TABLE emp ADD team INT; STORAGE FLUSH TABLE emp")
    assert rows(root.sql("SELECT team FROM emp ORDER BY id")) == [(None,)] * 4
    root.sql("ALTER TABLE emp ALTER COLUMN age SET DEFAULT 5")
    with pytest.raises(CatalogError):
        root.sql("ALTER TABLE emp ALTER COLUMN age SET NOT NULL")
    for bad in ("ALTER TABLE emp DROP COLUMN id", "ALTER TABLE emp ADD COLUMN NAME TEXT", "ALTER TABLE emp MODIFY COLUMN salary INT", "ALTER TABLE emp DROP COLUMN _seq"):
        with pytest.raises(CatalogError):
            root.sql(bad)
    assert root.sql("DESCRIBE TABLE emp").count() == 5 and root.sql("DESCRIBE TABLE emp HISTORY").count() > 10
    assert root.sql("SHOW STATS FOR TABLE emp").first().cold_versions == 4


def test_views_json_and_functions(root):
    root.sql("CREATE SHARED TABLE docs (id INT PRIMARY KEY, doc JSON)")
    root.sql("""INSERT INTO docs VALUES (1, '{"status":"active","n":3,"ok":true,"items":[10,20],"deep":{"k":"v"}}'), (2, '{"status":null}')""")
    q = "SELECT doc->>'status' AS s, doc->'deep'->>'k' AS k, doc->'items'->0 AS i, doc ? 'status' AS has, json_get_int(doc, 'n') AS n, json_get_bool(doc, 'ok') AS ok, json_length(doc, 'items') AS len FROM docs ORDER BY id"
    assert rows(root.sql(q)) == [("active", "v", "10", True, 3, True, 2), (None, None, None, True, None, None, None)]
    assert rows(root.sql("SELECT id FROM docs WHERE doc->>'status' = 'active' AND NOT doc ? 'zzz'")) == [(1,)]
    root.sql("CREATE VIEW active (k) AS SELECT id FROM docs WHERE doc->>'status' = 'active'")
    assert rows(root.sql("SELECT k + 1 FROM active")) == [(2,)]
    with pytest.raises(AlreadyExists):
        root.sql("CREATE VIEW active AS SELECT 1")
    with pytest.raises(SqlError):
        root.sql("CREATE MATERIALIZED VIEW m AS SELECT 1")
    assert rows(root.sql("SELECT CURRENT_USER() AS u, CURRENT_ROLE() AS r")) == [("root", "system")]
    assert rows(root.sql("SELECT $2 AS b, $1 AS a, $2 AS c", [1, "x"])) == [("x", 1, "x")]


def test_vectors(root):
    root.sql("CREATE SHARED TABLE vec (id INT PRIMARY KEY, e EMBEDDING(3)); ALTER TABLE vec CREATE INDEX e USING COSINE")
    root.sql("INSERT INTO vec VALUES (1, '[1,0,0]'), (2, '[0,1,0]'), (3, '[0.9,0.1,0]'), (4, NULL), (5, '[0,0,0]')")
    assert rows(root.sql("SELECT id FROM vec WHERE e IS NOT NULL ORDER BY COSINE_DISTANCE(e, '[1,0,0]'), id LIMIT 2")) == [(1,), (3,)]
    found = root.sql("SELECT v.id, f.score FROM vector_search('app.vec', 'e', '[1,0,0]', 3) f JOIN vec v ON f.row_id = CAST(v.id AS STRING) ORDER BY f.score DESC")
    got = rows(found)
    assert [g[0] for g in got][:2] == [1, 3] and abs(got[0][1] - 1) < 1e-6
    with pytest.raises(Exception, match="length"):
        root.sql("INSERT INTO vec VALUES (6, '[1,2]')")
    with pytest.raises(CatalogError):
        root.sql("ALTER TABLE vec CREATE INDEX id")


def test_stream_tables(engine, root):
    root.sql("CREATE STREAM TABLE typing (id BIGINT PRIMARY KEY DEFAULT SNOWFLAKE_ID(), who TEXT) WITH (TTL_SECONDS = 60)")
    ann = engine.session("ann", "user", "app")
    ann.sql("INSERT INTO typing (who) VALUES ('a'), ('b')")
    assert ann.sql("SELECT who FROM typing").count() == 2
    table = engine.catalog.table("app.typing")
    later = 10**13
    assert ann.read("typing", now_ms=later).count() == 0
    with pytest.raises(ConstraintError):
        ann.sql("UPDATE typing SET who = 'x' WHERE who = 'a'")
    with pytest.raises(CatalogError):
        jobs.flush(engine, table)
    assert jobs.evict_stream(engine, table, later) == 2 and ann.sql("SELECT * FROM typing").count() == 0
    with pytest.raises(SqlError):
        root.sql("CREATE STREAM TABLE t (id INT PRIMARY KEY)")


def test_live_queries(engine, root):
    root.sql("CREATE USER TABLE msg (id INT PRIMARY KEY, room TEXT, n INT)")
    ann = engine.session("ann", "user", "app")
    ann.sql("INSERT INTO msg VALUES (1,'a',1),(2,'b',2),(3,'a',3)")
    sub = ann.subscribe("SELECT id, n FROM app.msg WHERE room = 'a'")
    assert rows(sub.snapshot(), "id", "n") == [(1, 1), (3, 3)]
    assert [len(b) for b in ann.subscribe("SELECT * FROM msg", batch_size=2).batches()] == [2, 1]
    assert rows(ann.subscribe("SELECT id FROM msg", last_rows=2).snapshot(), "id") == [(2,), (3,)]
    ann.sql("INSERT INTO msg VALUES (4,'a',4),(5,'b',5)")
    ann.sql("UPDATE msg SET n = 30 WHERE id = 3; UPDATE msg SET room = 'b' WHERE id = 1; UPDATE msg SET room = 'a' WHERE id = 2; DELETE FROM msg WHERE id = 4")
    engine.session("bob", "user", "app").sql("INSERT INTO msg VALUES (9,'a',9)")
    got = sub.poll().collect()
    assert [(r.op, r.id) for r in got] == [("insert", 4), ("update", 3), ("delete", 1), ("insert", 2), ("delete", 4)]
    assert got[1].changed == ["n"] and got[1].old.n == 3
    assert sub.poll().count() == 0
    for bad in ("SELECT id FROM msg ORDER BY id", "SELECT DISTINCT id FROM msg", "SELECT count(*) FROM msg", "SELECT id FROM msg WHERE id = 1 LIMIT 3", "SELECT m.id FROM msg m JOIN msg n ON 1=1"):
        with pytest.raises(SqlError):
            ann.subscribe(bad)
    with pytest.raises(Exception):
        ann.subscribe("SELECT id FROM msg WHERE nope = 1")
    root.sql(f"KILL LIVE QUERY '{sub.id}'")
    assert not sub.active and sub.id not in engine.subscriptions
    assert ann.sql("SUBSCRIBE TO app.msg WHERE room = 'b' OPTIONS (last_rows = 5)").count() == 2


def test_topics(engine, root):
    employees(root)
    root.sql("CREATE TOPIC app.changes PARTITIONS 3; ALTER TOPIC app.changes ADD SOURCE app.emp ON INSERT WHERE salary > 10 WITH (payload = 'full'); ALTER TOPIC app.changes ADD SOURCE app.emp ON UPDATE WITH (payload = 'diff'); ALTER TOPIC app.changes ADD SOURCE app.emp ON DELETE WITH (payload = 'key')")
    root.sql("INSERT INTO emp VALUES (10,'A','x',5),(11,'B','x',50),(12,'C','x',60)")
    root.sql("UPDATE emp SET salary = 70 WHERE id = 11; DELETE FROM emp WHERE id = 12")
    got = root.sql("CONSUME FROM app.changes").collect()
    assert sorted((r.op, r.key) for r in got) == [("delete", "12"), ("insert", "11"), ("insert", "12"), ("update", "11")]
    body = {(r.op, r.key): bytes(r.payload).decode() for r in got}
    assert body["delete", "12"] == '{"id":12}' and '"salary":70' in body["update", "11"] and "name" not in body["update", "11"] and '"name":"B"' in body["insert", "11"]
    for p in range(3):
        assert sorted(r.offset for r in got if r.partition_id == p) == list(range(sum(r.partition_id == p for r in got)))
    assert root.sql("CONSUME FROM app.changes GROUP 'g' LIMIT 10").count() == 4
    assert root.sql("CONSUME FROM app.changes GROUP 'g' LIMIT 10").count() == 0
    later = engine.topics.consume("app.changes", "g", now_ms=10**13)
    assert len(later) == 4
    for p in range(3):
        if any(r.partition_id == p for r in got):
            root.sql(f"ACK app.changes GROUP 'g' PARTITION {p} UPTO OFFSET {max(r.offset for r in got if r.partition_id == p)}")
    assert engine.topics.consume("app.changes", "g", now_ms=2 * 10**13) == []
    assert root.sql("CONSUME FROM app.changes FROM LATEST").count() == 0
    assert jobs.retain_topic(engine, "app.changes", 0, 10**14) == 4
    with pytest.raises(AlreadyExists):
        root.sql("CREATE TOPIC app.changes")
    root.sql("DROP TOPIC app.changes")


def test_users_backup_export(engine, root, tmp_path):
    root.sql("CREATE USER 'ann' WITH PASSWORD 'pw' ROLE 'user'; CREATE USER 'dba1' WITH PASSWORD 'x' ROLE dba")
    assert engine.login("ann", "pw").role == "user"
    with pytest.raises(security.AccessDenied):
        engine.login("ann", "no")
    with pytest.raises(AlreadyExists):
        root.sql("CREATE USER 'ann'")
    employees(root)
    root.sql("CREATE USER TABLE notes (id INT PRIMARY KEY, body TEXT)")
    ann = engine.session("ann", "user", "app")
    ann.sql("INSERT INTO notes VALUES (1, 'a')")
    ann.sql("EXPORT USER DATA")
    assert rows(ann.sql("SHOW EXPORT"), "rows") == [(1,)]
    root.sql(f"BACKUP DATABASE app TO 'file://{tmp_path}/saved'")
    root.sql("DROP NAMESPACE app CASCADE")
    with pytest.raises(NotFound):
        root.sql("SELECT * FROM app.emp")
    root.sql(f"RESTORE DATABASE app FROM 'file://{tmp_path}/saved'")
    assert rows(root.sql("SELECT count(*) FROM app.emp")) == [(3,)] and rows(engine.session("ann", "user", "app").sql("SELECT body FROM notes")) == [("a",)]
    root.sql("DROP USER 'ann'")
    assert jobs.clean_users(engine, 0, 10**14) == 1 and engine.log(engine.catalog.table("app.notes")).current().count() == 0
    assert jobs.clean_jobs(engine, 0, 10**14) > 0


def test_catalog_statements(engine, root):
    root.sql("CREATE STORAGE s1 TYPE 'filesystem' NAME 'x' BASE_DIRECTORY 'file:///tmp/x'; ALTER STORAGE s1 SET NAME 'y'")
    assert root.sql("SHOW STORAGES").count() == 2 and root.sql("STORAGE CHECK local").first().healthy
    root.sql("DROP STORAGE s1; CREATE NAMESPACE IF NOT EXISTS app; ALTER NAMESPACE app SET OPTIONS (a = 1)")
    employees(root)
    assert root.sql("SHOW TABLES IN app").count() == 1 and root.sql("SHOW NAMESPACES").count() == 2
    assert "Scan parquet" in root.sql("EXPLAIN SELECT * FROM emp WHERE id = 1").first()[0]
    for name in ("users", "namespaces", "tables", "columns", "schemas", "storages", "jobs", "manifest", "topics", "topic_offsets", "stats", "live", "sessions", "transactions", "settings", "server_logs", "cluster", "cluster_groups", "datatypes", "describe", "audit_log", "job_nodes"):
        root.sql(f"SELECT * FROM system.{name}").collect()
    assert root.sql("SELECT * FROM information_schema.columns WHERE table_name = 'emp'").count() == 4
    assert root.sql("SHOW MANIFEST").count() == 1 and root.sql("CLUSTER LIST") is not None
    assert root.to_json(root.sql("SELECT id, _seq FROM emp"))["rows"][0][1].isdigit()
    with pytest.raises(SqlError):
        root.sql("FROBNICATE the table")
    with pytest.raises(CatalogError):
        root.sql("CREATE NAMESPACE system")
    root.sql("DROP TABLE emp; DROP TABLE IF EXISTS emp")


def test_default_limit(spark, tmp_path):
    s = Engine(spark, f"file://{tmp_path}", Settings(default_limit=2, most_rows=3)).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1),(2),(3),(4),(5)")
    assert s.sql("SELECT id FROM t").count() == 2 and s.sql("SELECT id FROM t LIMIT 100").count() == 3


def test_concurrent_writers(engine, root):
    """Two writers on one manifest: the later one publishes on top of the first; a key that came between is still refused."""
    employees(root)
    table = engine.catalog.table("app.emp")
    log, other = engine.log(table), engine.session("x", "system", "app")
    seen = []

    def meanwhile(segment):
        if not seen:
            seen.append(1)
            other.sql("INSERT INTO emp VALUES (50,'Mid','x',1)")

    from strandline.operators import dml

    rows = root.spark.createDataFrame([(60, "Late", "x", 1)], "id int, name string, dept string, salary int")
    commit = engine.next_commit()
    assert log.append(dml.versioned(rows, table, commit, None), commit, meanwhile) == 1
    assert rows.count() == 1 and root.sql("SELECT id FROM emp WHERE id >= 50").count() == 2
    before = len(engine.store.names("app", "emp", "hot"))
    with pytest.raises(ConstraintError):
        root.sql("INSERT INTO emp VALUES (60,'Dup','x',1)")
    assert len(engine.store.names("app", "emp", "hot")) == before


def test_transaction_publishes_by_operation(engine, root):
    employees(root)
    root.sql("CREATE TOPIC app.t; ALTER TOPIC app.t ADD SOURCE app.emp ON INSERT; ALTER TOPIC app.t ADD SOURCE app.emp ON UPDATE; ALTER TOPIC app.t ADD SOURCE app.emp ON DELETE")
    root.sql("CREATE SHARED TABLE two (id INT PRIMARY KEY); BEGIN; INSERT INTO emp VALUES (10,'n','x',1); UPDATE emp SET salary = 1 WHERE id = 1; DELETE FROM emp WHERE id = 2; INSERT INTO two VALUES (1); INSERT INTO emp VALUES (11,'n','x',1); DELETE FROM emp WHERE id = 11; COMMIT")
    assert sorted((r.op, r.key) for r in root.sql("CONSUME FROM app.t").collect()) == [("delete", "2"), ("insert", "10"), ("update", "1")]
    assert rows(root.sql("SELECT id FROM two")) == [(1,)] and not engine.store.exists("_transactions", "x")
    assert engine.store.names("_transactions") == []


def test_running_job_is_killed(engine, root):
    import threading
    import time

    failed = []

    def work():
        try:
            engine.run_job("flush", "slow", lambda: root.spark.range(0, 10**13, 1, 8).selectExpr("max(hash(id, id * 7))").collect())
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    job = None
    for _ in range(100):
        job = next((j for j in engine.catalog.all("jobs") if j["target"] == "slow"), None)
        if job:
            break
        time.sleep(0.1)
    time.sleep(2)
    root.sql(f"KILL JOB '{job['job_id']}'")
    thread.join(60)
    assert failed and not thread.is_alive() and engine.catalog.get("jobs", job["job_id"])["status"] == "cancelled"


def test_json_comes_in_pieces(root):
    import json

    employees(root)
    df = root.sql("SELECT id, name, _seq FROM emp")
    whole = json.loads("".join(root.stream_json(df)))
    assert whole == root.to_json(df) and [r[1] for r in whole["rows"]] == ["Alice", "Bob", "Charlie"]
    assert json.loads("".join(root.stream_json(df.limit(0))))["rows"] == []


def test_given_up_transactions_never_show(engine, root):
    """Segments whose transaction has no record yet don't show and hold back polls; aborted ones never show."""
    from strandline.operators import dml
    from strandline.sources.segments import decide

    employees(root)
    table = engine.catalog.table("app.emp")
    log, sub = engine.log(table), root.subscribe("SELECT id FROM emp")
    row = root.spark.createDataFrame([(77, "x", "y", 1)], "id int, name string, dept string, salary int")
    log.add(log.write_segments(dml.versioned(row, table, 1, None), "hot"), 1, tx="t1")
    root.sql("UPDATE emp SET salary = 0 WHERE id = 1")
    assert root.sql("SELECT id FROM emp WHERE id = 77").count() == 0 and sub.poll().count() == 0
    assert decide(engine.store, "t1", False) is False and decide(engine.store, "t1") is False
    assert root.sql("SELECT id FROM emp WHERE id = 77").count() == 0 and [r.id for r in sub.poll().collect()] == [1]


def test_two_consumers_share_a_group(engine, root):
    """Claims are stored: another engine of the same root goes on behind them, and acknowledgements hold there."""
    employees(root)
    root.sql("CREATE TOPIC app.q; ALTER TOPIC app.q ADD SOURCE app.emp ON UPDATE; UPDATE emp SET salary = 0 WHERE id > 0")
    other = Engine(root.spark, engine.store.root)
    a, b = (e.topics.consume("app.q", "g", limit=2) for e in (engine, other))
    assert [r["offset"] for r in a] == [0, 1] and [r["offset"] for r in b] == [2]
    other.topics.ack("app.q", "g", 0, 2)
    assert engine.topics.consume("app.q", "g", now_ms=10**13) == [] and engine.topics.committed("app.q", "g") == {0: 3}


def test_polls_that_fail_are_repeated(root, monkeypatch):
    employees(root)
    sub = root.subscribe("SELECT id FROM emp")
    root.sql("DELETE FROM emp WHERE id = 2")
    monkeypatch.setattr(sub, "_written", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sub.poll()
    monkeypatch.undo()
    assert [(r.op, r.id) for r in sub.poll().collect()] == [("delete", 2)]
