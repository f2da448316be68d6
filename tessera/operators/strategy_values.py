"""Values of the strategies that are fixed by the rules: word lists, tables, weights and steps."""

#: Words of the languages that renaming leaves alone.
KEYWORDS = """async await break case catch class const continue debugger default delete do else enum export extends false finally for function if
import in instanceof let new null of return super switch this throw true try typeof undefined var void while with yield interface type implements
static public private protected abstract as from get set readonly def lambda pass raise except nonlocal global assert elif is not and or None True
False print self cls""".split()
#: Tokens that begin a statement block, and tokens that open one.
STATEMENTS = "FunctionDef AsyncFunctionDef If For While Try With Return Assign AugAssign Expr Raise Assert Delete Import ClassDef".split()
OPENERS = "If For AsyncFor While Try TryStar With AsyncWith IfStatement ForStatement ForInStatement ForOfStatement WhileStatement DoStatement TryStatement WithStatement".split()
#: Weight of each strategy; one that is unknown weighs 0.5.
WEIGHTS = {
    "token_clone": 0.95, "llm_semantic": 0.9, "ast_similarity": 0.85, "pdg_semantic": 0.8, "tfidf_index": 0.75, "code_embedding": 0.72,
    "lsh_ast": 0.7, "bag_of_ast": 0.7, "winnowing": 0.65, "signature_match": 0.6, "fuzzy_name": 0.5, "metric_similarity": 0.45,
}
HIGH, MEDIUM, LOW = 0.80, 0.55, 0.35
SEQUENCE = ("bag_of_ast", "code_embedding", "pdg_semantic", "lsh_ast", "ast_similarity", "winnowing")
SURFACE = ("fuzzy_name", "signature_match", "metric_similarity")
#: Names of error factories.
FACTORIES = "notFound badRequest validationFailed noFieldsProvided conflict forbidden gone internal duplicate concurrentModification insufficientStock".split()
