import pytest
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators.filters import FilterError, extension_filter, parse_filter
from corvane.operators.lexical import analyse, identifier_variants, singular
from corvane.sources.ignore import clean_patterns, compile_rules, ignored, ignored_path, scoped

ROLES = {
    "src/dist/x.ts": "generated", "a/b.d.ts": "generated", "src/tests/x.py": "test", "tests/x.py": "implementation", "src/test_x.py": "test", "src/x.spec.ts": "test", "a/x_test.go": "test", "a/MyTest.java": "test",
    "src/config/x.ts": "config", ".env": "config", "package.json": "config", "src/docs/x.ts": "docs", "README.md": "docs", "a/x.scss": "style", "src/main.go": "entrypoint", "src/thing.rs": "implementation",
}


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_file_roles(spark):
    got = values(spark, [(p,) for p in ROLES], "p string", P.file_role(F.col("p")))
    assert dict(zip(ROLES, got, strict=True)) == ROLES


@pytest.mark.parametrize("path,content,role", [
    ("src/index.ts", "export * from './a';\nexport { b } from './b';", "barrel"), ("src/index.ts", "export class A {}", "implementation"),
    ("pkg/__init__.py", "from .a import b\n# note\n", "barrel"), ("pkg/__init__.py", "def f():\n    pass\n", "implementation"), ("src/mod.rs", "pub use a::b;\n", "barrel")])
def test_index_files(spark, path, content, role):
    assert values(spark, [(path, content)], "p string, c string", P.file_role(F.col("p"), F.col("c"))) == [role]


def test_tokens_and_segments(spark):
    df = spark.createDataFrame([("src/myFileName_x2/HTTPServer.ts",), ("",)], "p string")
    tok, s0, s4 = df.select(P.path_tokens(F.col("p")), P.segment(F.col("p"), 0), P.segment(F.col("p"), 4)).first()
    assert tok[:4] == ["src", "myFileName", "my", "File"] and "HTTPServer" in tok and "ts" in tok and (s0, s4) == ("src", "")
    assert P and [r[0] for r in df.select(P.structural_tokens(F.lit("A Bcd ef"))).limit(1).collect()] == [["ABcd", "ef"]]


@pytest.mark.parametrize("text,n", [("", 0), ("a\n\n// c\n# d\n-- e\nb", 2), ("/* x\ny */ code\nz", 2), ("/* a */ b\n<!-- c -->\n<!-- c --> d", 2), ("/*\n\n*/", 0), ("a /* b", 1)])
def test_effective_lines(spark, text, n):
    assert values(spark, [(text,)], "t string", T.effective_lines(F.col("t"))) == [n]


def test_symbols_and_signatures(spark):
    rows = [("export class Foo {}", "class", "Foo", "class:Foo"), ("def run(x):\n  pass", "function", "run", "def:run"), ("func (s *S) Go() {", "function", "Go", "func:Go"), ("no code here", None, None, None)]
    for text, kind, name, sig in rows:
        s, g = spark.createDataFrame([(text,)], "t string").select(T.symbol(F.col("t")), T.signature(F.col("t"), wide=True)).first()
        assert ((s.kind, s.name) if s else (None, None)) == (kind, name) and g == sig


def test_hash_ignores_spacing(spark):
    a, b = values(spark, [(" a\n  b\tc ",), ("a b c",)], "t string", T.normalised_hash(F.col("t")))
    assert a == b


def test_line_range(spark):
    df = spark.createDataFrame([("a\nb\nc", "5", None, 0, 0), ("a", None, None, 3, 2), ("a", None, None, 0, 0)], "c string, s string, e string, s2 int, e2 int")
    got = [tuple(r[0]) for r in df.select(T.line_range(F.col("c"), (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")))).collect()]
    assert got == [(5, 7, True), (3, 3, True), (0, 0, False)]


def test_filter_language(spark):
    df = spark.createDataFrame([("a", ".py", True), ("b", ".ts", False)], "relative_path string, file_extension string, is_definition boolean")
    pick = lambda f: [r.relative_path for r in df.filter(parse_filter(f, df.columns)).collect()]
    assert pick("file_extension in ['.py', \".go\"] or (is_definition == false and relative_path == 'b')") == ["a", "b"]
    assert pick("is_definition == true and file_extension == '.ts'") == []
    for bad in ("x == 1", "relative_path = 'a'", "relative_path == 'a' extra", "("):
        with pytest.raises(FilterError):
            parse_filter(bad, df.columns)
    with pytest.raises(FilterError):
        extension_filter(["py"])


def test_query_analysis():
    q = analyse("where is getUserById defined in tests for user_service.py")
    assert "getUserById" in q.anchors and "userService" not in q.anchors and "test" in q.roles
    assert identifier_variants("user_id") == ["user", "UserID", "userID"] and singular("queries") == "query" and analyse("main.go").filename == "main.go"
    assert q.weak == ["where", "defined", "for"] and "tests" in q.scoring and "UserService" in analyse("user_service").scoring and identifier_variants("security") == ["Security", "secure", "Secure"]
    r = analyse("GET /api/v1/users/list of MAX_SIZE")
    assert r.routes == [("/api/v1/users/list", "/api", "/v1/users/list"), ("/api/v1/users/list", "/v1", "/users/list")] and "/v1/users/list" in r.scoring and r.literals == ["/api/v1/users/list", "MAX_SIZE"]
    assert analyse("src/core/userFile-name").anchors[:3] == ["src/core/userFile-name", "userFile-name", "src"] and analyse("bootstrap state").phrases == [] and analyse("start state").phrases == ["startup"]
    assert analyse("command registration").recall[:4] == ["command", "Command", "commands", "Commands"] and analyse("the players queries").structure == ["queries", "query", "queri", "querie"]


def test_structure_and_owner(spark):
    from corvane.operators.lexical import names_path, owner_signal, structure_score

    q = analyse("user service tests in src/api")
    rows = [("src/api/UserService.ts", "export class UserService {}", "definition", ["path_match"], 1.0), ("src/x/user.ts", "user", "re_export", ["reference_match"], 200.0),
            ("tests/user_services.ts", "// note\nfunction f() {", "test_case", ["exact_filename", "reference_match"], 1.0), ("a.ts", "", None, [], 1.0)]
    df = spark.createDataFrame(rows, "p string, c string, r string, why array<string>, s double")
    got = values(spark, rows, df.schema, structure_score(F.col("r"), F.col("p"), F.col("c"), F.col("why"), q))
    assert got == [140 + 90 + 32 + 8 + 60, -140 - 20, -80 + 90 + 32 + 60, 0]
    assert values(spark, rows, df.schema, names_path(F.col("p"), q)) == [True, True, False, False]
    assert values(spark, rows, df.schema, owner_signal(F.col("why"), F.col("s"), F.col("c"), F.col("p"), q)) == [1, 1, 0, 2]


def test_ignore_rules(spark):
    assert clean_patterns(["# c", "", " a ", "a"]) == ["a"] and scoped("*.log", "sub") == "/sub/**/*.log" and scoped("!x/y", "sub") == "!/sub/x/y"
    rules = compile_rules(["*.log", "!keep.log", "build/", "/top", "a/**/z"])
    cases = {"x.log": True, "d/keep.log": False, "build/x": True, "buildx": False, "top": True, "d/top": False, "a/b/c/z": True, "a/z": True, ".git/x": True, "ok.py": False}
    assert {p: ignored_path(p, rules) for p in cases} == cases
    got = values(spark, [(p,) for p in cases], "p string", ignored(F.col("p"), ["*.log", "!keep.log", "build/", "/top", "a/**/z"]))
    assert got == list(cases.values())


@pytest.mark.parametrize("lang,text,names", [
    ("typescript", "export class A {}\n// class B\nconst c = 1\nfunction d() {}", ["A", "c", "d"]), ("python", "class A:\n  async def b(self):\n    pass\n# def x()", ["A", "b"]),
    ("go", "func (s *S) Run() {\ntype T struct {", ["Run", "T"]), ("rust", "pub async fn go(x: i32) {\npub struct P;", ["go", "P"]), ("c", "#define MAX 1\nint main(int argc) {\nstruct s {", ["MAX", "main", "s"]),
    ("java", "public class A {\n  private static int f(int x) {", ["A", "f"]), ("toml", "[tool.black]", ["tool.black", "black"]), ("markdown", "# Title\ntext\n```\ndef f():\n```\ndef g():", ["Title", "f"]), ("json", "class A", []), ("cmake", "macro(add_it x)", ["add_it"])])
def test_definition_identifiers(spark, lang, text, names):
    from corvane.functions.definitions import definition_identifiers

    assert values(spark, [(text, lang)], "t string, l string", definition_identifiers(F.col("t"), F.col("l"))) == [names]


def test_phrases(spark):
    from corvane.operators.lexical import lexical_score, phrase_score

    terms = analyse("where are commands registered centrally for the cli")
    assert "commands" not in terms.phrases and analyse("command registration owner").phrases == ["owner", "commands"]
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([("src/cmd/root.go", "register the command here"), ("a/b.go", "register the command"), ("a/c.go", "nothing")], "relative_path string, content string")
    df = df.withColumn("path_tokens", none).withColumn("symbols", none).withColumn("definition_identifiers", none).withColumn("content_definitions", none).withColumn("file_role", F.lit("implementation"))
    assert [r[0] for r in df.select(phrase_score(["commands"])).collect()] == [240, 150, 0]
    assert [r[0] > 0 for r in df.select(lexical_score(analyse("command registration owner"))[0]).collect()] == [True, True, False]
    said = [("cmd/startup.go", "x", 220), ("a.go", "dispatch the environment commands", 240), ("a.go", "global state", 0), ("a/router.go", "r.Group(x)", 220), ("a/route.go", "app.GET ('x')", 180), ("a.go", "app.GET('x')", 0),
            ("m.go", "func pick() {\n switch apiType {", 260), ("m.go", "// x\ncase 1: switch apiType {", 190), ("my/adaptor.go", "x", 260), ("q.go", "map of adapters", 140)]
    of = {"startup": said[:3], "grouped routes": said[3:4], "registered routes": said[4:6], "mapping": said[6:8], "adapters": said[8:]}
    for name, rows in of.items():
        df = spark.createDataFrame([r[:2] for r in rows], "relative_path string, content string")
        df = df.withColumn("path_tokens", none).withColumn("symbols", none).withColumn("definition_identifiers", none)
        assert [r[0] for r in df.select(phrase_score([name])).collect()] == [r[2] for r in rows], name


def test_follow_up_symbols(spark):
    text = 'import { Aa, bb as Cc, Dd as ee } from "x"\nclass Ff extends Gg implements Map {\n  hh: Ii = new Jj() as Kk\n}\nexport { Ll }'
    assert sorted(values(spark, [(text,)], "t string", T.follow_up_symbols(F.col("t")))[0]) == ["Aa", "Cc", "Dd", "Ff", "Gg", "Ii", "Jj", "Kk", "Ll"]


def test_similar_files_share_lines_enough(spark, tmp_path):
    """All pairs by brute force, with a line in every text, and ids that come again with other texts; what can be like nothing goes no further."""
    import random

    from corvane.operators.ranking import similar_files_lines

    rng = random.Random(3)
    rows = []
    for i in range(150):
        own = [f"line {i} number {j}" for j in range(rng.randint(0, 6))]
        rows.append(("xy"[i % 2], i // 2 if i > 100 else i, "\n".join(["in every text", *rng.sample([f"common line {j}" for j in range(12)], rng.randint(0, 5)), *own])))
    rows += [("x", 500 + i, "\n".join(["in every text", *(f"text {i} has line {j}" for j in range(3))])) for i in range(200)]
    df = spark.createDataFrame(rows, "relative_path string, id long, content string")
    for least in (0.25, 0.6):
        classes = {}
        for path, i, text in rows:
            if len(ls := frozenset(text.split("\n"))) >= 4:
                classes[path, ls] = min(i, classes.get((path, ls), i))
        want = sorted((p, i, j, len(a & b) / len(a | b)) for (p, a), i in classes.items() for (q, b), j in classes.items() if p == q and i < j and len(a & b) / len(a | b) >= least)
        folder = f"{tmp_path}/sets-{least}"
        members, pairs = similar_files_lines(df, least)
        assert sorted(tuple(r) for r in pairs.collect()) == want and want
        assert members.count() == sum(len(set(t.split("\n"))) >= 4 for _, _, t in rows)
        assert sorted(tuple(r) for r in similar_files_lines(df, least, folder)[1].collect()) == want
        assert not spark.read.parquet(folder).filter("node.id >= 500").count()
