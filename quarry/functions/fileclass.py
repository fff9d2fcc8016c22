"""What a file is, from its name and the first bytes of its text: manifest, build file, or a counted language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Manifests by name and by suffix, and the keys that make a .psd1 file one.
MANIFESTS = (
    "pyproject.toml setup.py setup.cfg Pipfile package.json pnpm-workspace.yaml go.mod go.work Cargo.toml pom.xml build.gradle build.gradle.kts "
    "settings.gradle settings.gradle.kts Gemfile composer.json CMakeLists.txt meson.build"
).split()
MANIFEST_SUFFIXES = (".csproj", ".sln", ".slnx", ".gemspec")
MODULE_KEYS = ("ModuleVersion", "RootModule", "ModuleToProcess")
# The language counted for each suffix.
SUFFIXES = {
    "Python": ".py .pyi", "JavaScript": ".js .mjs .cjs .jsx", "TypeScript": ".ts .mts .cts", "TSX": ".tsx", "Go": ".go", "Rust": ".rs", "Java": ".java", "Kotlin": ".kt .kts",
    "C#": ".cs", "Ruby": ".rb", "PHP": ".php", "C": ".c .h", "C++": ".cpp .cc .cxx .hpp .hh .hxx", "PowerShell": ".ps1 .psm1 .psd1", "shell": ".sh .bash .zsh .fish .ksh",
}
# Build files by name, by prefix and by suffix; and texts that are never read for it.
BUILD_NAMES = (
    "Makefile makefile GNUmakefile BSDmakefile Makefile.am makefile.am Makefile.in makefile.in Justfile justfile Taskfile.yml Taskfile.yaml Rakefile Dockerfile Containerfile "
    "docker-compose.yml docker-compose.yaml compose.yml compose.yaml Jenkinsfile .gitlab-ci.yml azure-pipelines.yml .travis.yml appveyor.yml .drone.yml cloudbuild.yaml cloudbuild.yml "
    "buildspec.yml appspec.yml Procfile fly.toml render.yaml serverless.yml serverless.yaml skaffold.yaml skaffold.yml Chart.yaml Chart.yml kustomization.yaml kustomization.yml "
    "Pulumi.yaml Pulumi.yml Vagrantfile ansible.cfg"
).split()
BUILD_PREFIXES = ("Dockerfile.", "Containerfile.", "Jenkinsfile.")
BUILD_SUFFIXES = (".mk", ".mak", ".make", ".dockerfile", ".tf", ".tfvars", ".tf.json", ".bicep", ".nomad", ".pkr.hcl", ".pkr.json", ".pp", ".sls")
PROSE_SUFFIXES = (".md", ".markdown", ".mdown", ".rst")

# White space and word characters as Unicode has them; lines end at \n only ((?d)).
_S = r"[\s\x{1c}-\x{1f}]"
_LINE = r"(?:^|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"


def _ends(name: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower(name).endswith(s)
    return out


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?Ud)" + pattern)


def _line(text: Column, pattern: str) -> Column:
    return text.rlike("(?Umd)" + pattern)


def language_of(name: Column) -> Column:
    """The label of the last suffix; a leading dot alone makes none."""
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))
    pairs = [(s, label) for label, all_ in SUFFIXES.items() for s in all_.split()]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(table[suffix], F.lit("other"))


def is_manifest(name: Column) -> Column:
    return name.isin(MANIFESTS) | _ends(name, MANIFEST_SUFFIXES)


def is_named_build(name: Column, path: Column) -> Column:
    out = name.isin(BUILD_NAMES) | _ends(name, BUILD_SUFFIXES)
    for p in BUILD_PREFIXES:
        out = out | name.startswith(p)
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return out | (path == ".circleci/config.yml") | path.endswith("/.circleci/config.yml")


def probe_text(head: Column) -> Column:
    """The text of a file's first bytes; null if they hold a NUL or could not be read."""
    return F.when(~F.contains(head, F.lit(b"\0")), F.make_valid_utf8(head.cast("string")))


def top_key(text: Column, key: str) -> Column:
    return text.rlike(f"(?Ud){_LINE}['\"]?{key}['\"]?{_S}*:")


def is_cloudformation(t: Column) -> Column:
    return t.contains("AWSTemplateFormatVersion") | _has(t, rf"['\"]?Transform['\"]?{_S}*:{_S}*['\"]?AWS::Serverless") | _has(t, rf"['\"]?Type['\"]?{_S}*:{_S}*['\"]?AWS::")


def is_kubernetes(t: Column) -> Column:
    return _has(t, rf"['\"]?apiVersion['\"]?{_S}*:") & _has(t, rf"['\"]?kind['\"]?{_S}*:")


def is_ansible(t: Column) -> Column:
    return _line(t, rf"^[ \t-]*hosts{_S}*:") & _line(t, rf"^[ \t-]*(tasks|roles|pre_tasks|handlers){_S}*:")


def is_docker(t: Column) -> Column:
    return _line(t, rf"^FROM{_S}+[^\s\x{{1c}}-\x{{1f}}]") & _line(t, rf"^(RUN|COPY|ADD|CMD|ENTRYPOINT|WORKDIR){_S}")


def is_make(t: Column) -> Column:
    define = _line(t, r"^define[ \t]+[^\s\x{1c}-\x{1f}]") & _line(t, rf"^endef{_S}*$")
    return _line(t, r"^\.(PHONY|SUFFIXES)\b") | define | _line(t, r"^if(eq|def|neq|ndef)[ \t]+[^\s\x{1c}-\x{1f}]")


def is_yaml_build(t: Column) -> Column:
    compose = top_key(t, "services") & _line(t, rf"^[ \t-]*['\"]?(image|build)['\"]?{_S}*:")
    return is_cloudformation(t) | (top_key(t, "on") & top_key(t, "jobs")) | is_ansible(t) | compose | is_kubernetes(t)


def is_json_build(t: Column) -> Column:
    return is_cloudformation(t) | t.contains("deploymentTemplate.json") | _has(t, rf"['\"]type['\"]{_S}*:{_S}*['\"]Microsoft\.") | is_kubernetes(t)


def classify(name: Column, path: Column, head: Column) -> tuple[Column, Column]:
    """(kind: marker | build | file, label of a counted file or the empty string); the first rule that fits decides."""
    text = probe_text(head)
    keys = F.lit(False)
    for k in MODULE_KEYS:
        keys = keys | text.contains(k)
    built = F.when(_ends(name, (".yml", ".yaml")), is_yaml_build(text)).when(_ends(name, (".json",)), is_json_build(text)).otherwise(is_docker(text) | is_make(text))
    kind = (
        F.when(is_manifest(name), "marker")
        .when(_ends(name, (".psd1",)), F.when(F.coalesce(keys, F.lit(False)), "marker").otherwise("file"))
        .when(is_named_build(name, path), "build")
        .when(F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)).isin(*PROSE_SUFFIXES), "file")
        .when(F.coalesce(built, F.lit(False)), "build")
        .otherwise("file")
    )
    return kind, F.when(kind == "file", language_of(name)).otherwise("")
