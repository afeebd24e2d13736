"""Boilerplate classes of functions: an ordered registry of predicates, first match wins.

Inputs are columns of a symbol: name, calls array<string>, decorators string, file,
branches long, kind.  Users put rules of their own in front; a rule whose language
is known and differs from the symbol's does not apply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Symbol:
    """Columns that predicates may use."""

    name: Column
    calls: Column
    decorators: Column
    file: Column
    branches: Column
    language: Column

    def calls_any(self, pattern: str) -> Column:
        return F.exists(self.calls, lambda c: c.rlike(pattern))

    def few(self, n: int) -> Column:
        return F.size(self.calls) <= n


@dataclass(frozen=True)
class Rule:
    category: str
    family: str  # js, rust, csharp or any
    test: Callable[[Symbol], Column]


_LANGS = {"js": ["javascript", "typescript", "vue"], "rust": ["rust"], "csharp": ["csharp"]}


def _name(p: str) -> Callable[[Symbol], Column]:
    return lambda s: s.name.rlike(p)


def _mark(p: str) -> Callable[[Symbol], Column]:
    return lambda s: s.decorators.rlike(p)


def _call(p: str) -> Callable[[Symbol], Column]:
    return lambda s: s.calls_any(p)


RULES: list[Rule] = [
    Rule("react_query", "js", _call(r"^use(Infinite|Suspense)?Query$|^useMutation$")),
    Rule("react_hook_wrapper", "js", lambda s: s.name.rlike(r"^use[A-Z]") & (s.branches == 0) & s.few(2) & s.calls_any(r"^use[A-Z]")),
    Rule("event_handler", "js", lambda s: s.name.rlike(r"^(handle|on)[A-Z]") & s.few(2) & (s.branches <= 1)),
    Rule("test_setup", "js", _name(r"^(before|after)(Each|All)$|^(setup|teardown)$")),
    Rule("type_guard", "js", lambda s: s.name.rlike(r"^(is|has)[A-Z]") & s.few(1) & (s.branches <= 1)),
    Rule("api_route", "js", lambda s: s.name.isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") | (s.file.rlike(r"/api/") & (s.name == "handler"))),
    Rule("config_export", "js", lambda s: s.file.rlike(r"\.config\.[cm]?[jt]s$") & (s.branches == 0)),
    Rule("redux_pattern", "js", _call(r"^(createSlice|createAsyncThunk|createSelector|configureStore)$")),
    Rule("validation_schema", "js", lambda s: s.name.rlike(r"[sS]chema$") & s.calls_any(r"^(z|yup|Joi)\.")),
    Rule("test_mock", "js", lambda s: s.name.rlike(r"^(mock|fake|stub)[A-Z]") | s.calls_any(r"^(jest|vi)\.(fn|mock)$")),
    Rule("nextjs_data_fetching", "js", _name(r"^(getServerSideProps|getStaticProps|getStaticPaths|generateMetadata|generateStaticParams)$")),
    Rule("react_wrapper", "js", lambda s: s.calls_any(r"^(React\.)?(memo|forwardRef|lazy)$") & s.few(2)),
    Rule("classic_reducer", "js", lambda s: s.name.rlike(r"[rR]educer$") & s.few(1)),
    Rule("context_provider", "js", _name(r"Provider$")),
    Rule("rust_test", "rust", lambda s: s.decorators.rlike(r"\btest\b") | s.name.rlike(r"^test_")),
    Rule("rust_trait_impl", "rust", _name(r"^(fmt|eq|ne|cmp|partial_cmp|hash|clone|default|borrow|as_ref)$")),
    Rule("rust_setter", "rust", lambda s: s.name.rlike(r"^set_") & s.few(1) & (s.branches == 0)),
    Rule("rust_builder", "rust", lambda s: s.name.rlike(r"^(with_|build$|builder$)") & s.few(3)),
    Rule("rust_getter", "rust", lambda s: s.name.rlike(r"^(get_|is_|has_)") & s.few(1) & (s.branches == 0)),
    Rule("rust_constructor", "rust", lambda s: s.name.rlike(r"^new(_|$)") & s.few(3) & (s.branches == 0)),
    Rule("rust_conversion", "rust", lambda s: s.name.rlike(r"^(from|into|try_from|try_into)(_|$)|^(to|as)_") & s.few(3)),
    Rule("rust_iterator", "rust", _name(r"^(next|next_back|into_iter|iter|iter_mut|size_hint)$")),
    Rule("rust_deref", "rust", _name(r"^deref(_mut)?$")),
    Rule("rust_drop", "rust", _name(r"^drop$")),
    Rule("rust_serde", "rust", _name(r"^(de)?serialize(_|$)")),
    Rule("xunit_test", "csharp", _mark(r"\b(Fact|Theory)\b")),
    Rule("nunit_test", "csharp", _mark(r"\b(Test|TestCase|SetUp|TearDown)\b")),
    Rule("moq_setup", "csharp", _call(r"(^|\.)(Setup|Verify|Returns)$")),
    Rule("unity_lifecycle", "csharp", _name(r"^(Awake|Start|Update|FixedUpdate|LateUpdate|OnEnable|OnDisable|OnDestroy)$")),
    Rule("unity_serialized_field", "csharp", _mark(r"\bSerializeField\b")),
    Rule("aspnet_controller", "csharp", _mark(r"\b(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route|ApiController)\b")),
    Rule("aspnet_minimal_api", "csharp", _call(r"\.?Map(Get|Post|Put|Delete|Patch)$")),
    Rule("aspnet_middleware", "csharp", _name(r"^Invoke(Async)?$")),
    Rule("aspnet_di", "csharp", _call(r"\.?Add(Scoped|Singleton|Transient)$")),
    Rule("ef_configuration", "csharp", _name(r"^(OnModelCreating|OnConfiguring)$")),
    Rule("property_accessor", "csharp", lambda s: s.name.rlike(r"^(get_|set_)") & s.few(0)),
    Rule("equality_members", "csharp", _name(r"^(Equals|GetHashCode|ToString|CompareTo)$")),
    Rule("dispose", "csharp", _name(r"^Dispose(Async)?$")),
]


def custom(category: str, name_glob: str | None = None, file_glob: str | None = None, max_calls: int | None = None) -> Rule:
    """A user's rule: all given limits must hold."""
    from codeframe.functions.paths import glob_regex

    def test(s: Symbol) -> Column:
        out = F.lit(True)
        if name_glob is not None:
            out &= s.name.rlike(glob_regex(name_glob))
        if file_glob is not None:
            out &= s.file.rlike(glob_regex(file_glob, deep=True))
        return out if max_calls is None else out & s.few(max_calls)

    return Rule(category, "any", test)


def classify(s: Symbol, extra: list[Rule] = []) -> Column:  # noqa: B006
    """The category of the first rule that holds, custom rules first; null where none does."""
    branches = []
    for r in [*extra, *RULES]:
        fits = F.coalesce(r.test(s), F.lit(False))
        if r.family != "any":
            fits &= s.language.isNull() | s.language.isin(_LANGS[r.family])
        branches.append(F.when(fits, r.category))
    return F.coalesce(*branches)


#: Framework entry points by file and name: (framework, file pattern, name pattern).
ENTRY_POINTS = [
    ("nextjs_page", r"(^|/)pages/(?!api/).*\.[jt]sx?$", r".*"), ("nextjs_api", r"(^|/)pages/api/.*\.[jt]s$", r".*"), ("nextjs_app", r"(^|/)app/(.*/)?(page|layout|route|loading|error)\.[jt]sx?$", r".*"),
    ("express_route", r"(^|/)routes?/.*\.[jt]s$", r".*"), ("nest_controller", r"\.controller\.ts$", r".*"), ("nest_service", r"\.service\.ts$", r".*"), ("nest_module", r"\.module\.ts$", r".*"),
    ("angular_component", r"\.component\.ts$", r".*"), ("vue_component", r"\.vue$", r".*"), ("pinia_store", r"(^|/)stores?/.*\.[jt]s$", r"^use\w+Store$"), ("react_component", r"\.[jt]sx$", r"^[A-Z]"), ("main", r".*", r"^(main|Main)$"),
]


def entry_point(file: Column, name: Column) -> Column:
    return F.coalesce(*[F.when(file.rlike(f) & name.rlike(n), kind) for kind, f, n in ENTRY_POINTS], F.lit("none"))
