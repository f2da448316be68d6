"""A small function catalog with its truth, as literal rows: what the strategies' queries run on, in both engines.

Shapes are those of ``read_catalog``; any table of that shape can be given to the strategies instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.strategies_sql import literal

_LOAD = "FunctionDef arguments arg Assign Name Call Attribute Name For Name Call If Compare Name Constant Expr Call Return Name"
_MERGE = "FunctionDef arguments arg arg Assign Dict For Tuple Call Assign Subscript Name If Compare In Assign Name Return Name"
_CHECK = "def check ( value ) : if not value : raise Error ( value ) return value"
_RENAMED = "def verify ( item ) : if not item : raise Fault ( item ) return item"
_PARSE = "FunctionDef arguments arg Try Assign Call Attribute Name Return Name ExceptHandler Raise Call Name With Call Assign Name Expr Call"
_COUNT = "FunctionDef arguments arg Assign Constant For Name Name AugAssign Name Constant If Compare Continue Return Name"
_SUM = "FunctionDef arguments arg Return Call Name GeneratorExp Compare comprehension Name If BoolOp Expr Name"
_SORT = "FunctionDef arguments arg While Compare Assign Name For Call If Compare Assign Tuple Assign Name AugAssign Name Return Name"

#: file, name, line, body_lines, end_line, params (name:type, "?" for an optional one), return_type, complexity, fingerprint, tokens
_ROWS = (
    ("a/load.py", "loadUserFile", 1, 12, 12, "path:str", "List[str]", 4, "f1", _LOAD),
    ("b/load.py", "readUserFile", 8, 12, 19, "path:str", "list", 4, "f1", _LOAD),
    ("b/load.py", "fetch_user_file", 40, 11, 50, "location:string", "Array<string>", 4, None, _LOAD.replace("If Compare Name Constant", "If Call Name Constant")),
    ("c/io.py", "loadCfgFile", 3, 14, 16, "path:str,strict:bool?", "dict", 5, None, _LOAD.replace("Expr Call", "Expr Call Assign Name Call")),
    ("a/merge.py", "mergeOptions", 5, 9, 13, "left:dict,right:dict", "dict", 3, "f2", _MERGE),
    ("c/merge.ts", "combineOpts", 11, 10, 20, "left:Record<string>,right:object", "object | null", 3, "f2", _MERGE.replace("If Compare In", "If Compare NotIn")),
    ("a/check.py", "checkValue", 1, 4, 4, "value:", None, 2, None, _CHECK),
    ("b/check.py", "verify_item", 2, 4, 5, "item:", None, 2, None, _RENAMED),
    ("c/check.py", "checkValue", 7, 4, 10, "value:", None, 2, None, _CHECK),
    ("a/parse.py", "parseReq", 20, 15, 34, "req:bytes", "Request", 6, None, _PARSE),
    ("b/parse.py", "parseRequest", 31, 16, 46, "request:bytes", "Request", 6, None, _PARSE + " Pass"),
    ("a/count.py", "countActive", 2, 7, 8, "users:list", "int", 3, "f3", _COUNT),
    ("b/count.py", "sumActiveUsers", 4, 3, 6, "users:Iterable[User]", "number", 3, "f4", _SUM),
    ("c/sort.py", "sortItems", 1, 25, 25, "items:list,key:function?", "list", 7, "f5", _SORT),
    ("c/sort.py", "orderItems", 40, 24, 63, "items:list,key:Callable?", "Sequence[int]", 7, None, _SORT.replace("While Compare", "While BoolOp Compare")),
    ("api/user.ts", "createUser", 1, 6, 6, "body:User", "Promise<User>", 1, None, "FunctionDef arguments arg Assign Await Call Attribute Return Name Expr Call"),
    ("api/user.ts", "updateUser", 10, 6, 15, "body:User", "Promise<User>", 1, None, "FunctionDef arguments arg Assign Await Call Attribute Return Name Expr Await"),
    ("api/storage-error.ts", "notFound", 1, 2, 2, "id:string", "Error", 1, None, "FunctionDef arguments arg Return Call Name"),
    ("api/storage-error.ts", "conflict", 5, 2, 6, "id:string", "Error", 1, None, "FunctionDef arguments arg Return Call Name"),
    (None, "lonely", None, None, None, "", None, None, None, ""),
    ("a/log.py", "logError", 1, 3, 3, "msg:str", "None", 1, None, "FunctionDef arguments arg Expr Call Attribute Name Name"),
    ("b/log.py", "logErr", 9, 3, 11, "message:str", "void", 1, None, "FunctionDef arguments arg Expr Call Attribute Name Constant"),
)

#: Pairs (a, b) by number of row, their clone type, and whether they are clones.
TRUTH = ((0, 1, 1, True), (6, 8, 1, True), (6, 7, 2, True), (7, 8, 2, True), (4, 5, 3, True), (9, 10, 3, True), (0, 2, 3, True), (13, 14, 3, True), (11, 12, 4, True), (0, 4, None, False), (15, 16, None, False), (6, 11, None, False), (3, 9, None, False))

#: Groups of a semantic reading: number of the group, stated confidence, functions.
GROUPS = ((1, "HIGH", (11, 12)), (2, "MEDIUM", (0, 2, 3)), (3, "LOW", (13, 14)), (4, "UNSURE", (20, 21)))

CATALOG = "id bigint, file string, name string, qualified_name string, line bigint, end_line bigint, body_lines bigint, params array<struct<name:string,type:string,optional:boolean>>, return_type string, cyclomatic_complexity bigint, ast_fingerprint string, token_sequence array<string>"


def _params(text: str) -> list[tuple[str, str, bool]]:
    parts = [p.split(":") for p in text.split(",") if p]
    return [(n, t.rstrip("?"), t.endswith("?")) for n, t in parts]


def rows() -> list[tuple]:
    return [(k, f, n, n, line, end, body, _params(p), ret, cc, fp, tokens.split()) for k, (f, n, line, body, end, p, ret, cc, fp, tokens) in enumerate(_ROWS)]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), CATALOG)


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUTH), "a bigint, b bigint, clone_type int, is_clone boolean")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, c, list(f)) for g, c, f in GROUPS], "grp bigint, confidence string, functions array<bigint>")


def values(table: list[tuple] | tuple, columns: str, name: str) -> str:
    """CTE ``name(columns)`` of literal rows for DuckDB."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in table)})"


def catalog_sql() -> str:
    """CTEs cat, truth and grps for DuckDB; lists without elements are typed."""
    fixed = "id, file, name, qualified_name, line, end_line, body_lines, params, return_type, cyclomatic_complexity, ast_fingerprint, token_sequence"
    body = values(rows(), fixed, "cat_raw")
    typed = "CAST(params AS STRUCT(name VARCHAR, type VARCHAR, optional BOOLEAN)[]) AS params"
    return f"{body}, cat AS (SELECT * REPLACE ({typed}, CAST(token_sequence AS VARCHAR[]) AS token_sequence) FROM cat_raw), {values(TRUTH, 'a, b, clone_type, is_clone', 'truth')}, {values([(g, c, list(f)) for g, c, f in GROUPS], 'grp, confidence, functions', 'grps')}"
