"""Fixed values that results depend on."""

from __future__ import annotations

# Language -> file extensions.
EXTENSIONS = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp", "hxx", "hh"],
    "ruby": ["rb", "rake", "gemspec", "ru"],
    "elixir": ["ex", "exs"],
    "zig": ["zig", "zon"],
    "csharp": ["cs"],
    "fsharp": ["fs", "fsi", "fsx", "fsscript"],
    "swift": ["swift"],
    "php": ["php"],
    "haskell": ["hs", "lhs"],
    "bash": ["sh", "bash", "zsh", "ksh"],
    "terraform": ["tf", "tfvars"],
    "kotlin": ["kt", "kts"],
    "dart": ["dart"],
    "lua": ["lua"],
    "clojure": ["clj", "cljs", "cljc", "edn"],
    "ocaml": ["ml", "mli"],
    "julia": ["jl"],
    "nix": ["nix"],
    "gleam": ["gleam"],
    "vue": ["vue"],
    "svelte": ["svelte"],
    "astro": ["astro"],
    "prisma": ["prisma"],
    "typst": ["typ", "typc"],
    "yaml": ["yaml", "yml"],
}
# Names of languages for people; their ids for language servers are the names above.
DISPLAY_NAMES = {
    "rust": "Rust", "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "go": "Go", "java": "Java", "c": "C", "cpp": "C++", "ruby": "Ruby", "elixir": "Elixir", "zig": "Zig",
    "csharp": "C#", "fsharp": "F#", "swift": "Swift", "php": "PHP", "haskell": "Haskell", "bash": "Bash", "terraform": "Terraform", "kotlin": "Kotlin", "dart": "Dart", "lua": "Lua", "clojure": "Clojure",
    "ocaml": "OCaml", "julia": "Julia", "nix": "Nix", "gleam": "Gleam", "vue": "Vue", "svelte": "Svelte", "astro": "Astro", "prisma": "Prisma", "typst": "Typst", "yaml": "YAML",
}
# Kinds of symbols by the numbers that language servers use; any other is a variable.
SERVER_KINDS = {2: "Module", 3: "Module", 4: "Module", 5: "Class", 6: "Method", 7: "Property", 8: "Field", 9: "Method", 10: "Enum", 11: "Interface", 12: "Function", 13: "Variable", 14: "Constant", 23: "Struct", 26: "Type"}
# Tools that need a language server, that prefer one, and that an outline can stand in for.
NEEDS_SERVER = ["rename_symbol"]
PREFERS_SERVER = ["get_diagnostics", "find_references", "analyze_impact"]
OUTLINE_SERVES = ["get_symbols", "get_structure"]
# Longest source file, in lines, that a project summary reads; most symbols that a search returns.
SUMMARY_LINES, SEARCH_SYMBOLS = 10_000, 5000
# Further names of languages.
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "rb": "ruby", "ex": "elixir", "c#": "csharp", "f#": "fsharp", "hs": "haskell", "sh": "bash", "tf": "terraform", "kt": "kotlin", "clj": "clojure", "ml": "ocaml", "jl": "julia", "yml": "yaml"}
# Languages with pattern sets of their own.
PATTERN_LANGUAGES = ["rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "ruby", "php", "bash", "csharp", "elixir", "lua", "swift", "zig", "haskell"]
# Files that mark a project root, by language; "*" matches any start of a name.
ROOT_MARKERS = {
    "rust": ["Cargo.toml", "Cargo.lock"],
    "python": ["pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "pyrightconfig.json"],
    "javascript": ["tsconfig.json", "package.json", "jsconfig.json"],
    "typescript": ["tsconfig.json", "package.json", "jsconfig.json"],
    "go": ["go.work", "go.mod", "go.sum"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "c": ["CMakeLists.txt", "compile_commands.json", "Makefile"],
    "cpp": ["CMakeLists.txt", "compile_commands.json", "Makefile"],
    "ruby": ["Gemfile"],
    "elixir": ["mix.exs", "mix.lock"],
    "zig": ["build.zig", "build.zig.zon"],
    "csharp": ["*.sln", "*.slnx", "*.csproj", "global.json"],
    "fsharp": ["*.sln", "*.slnx", "*.fsproj", "global.json"],
    "swift": ["Package.swift"],
    "php": ["composer.json", "composer.lock"],
    "haskell": ["cabal.project", "stack.yaml", "*.cabal"],
    "terraform": ["main.tf", "terraform.tfvars"],
    "kotlin": ["build.gradle.kts", "build.gradle", "pom.xml"],
    "dart": ["pubspec.yaml", "pubspec.lock"],
    "lua": [".luarc.json", ".luacheckrc"],
    "clojure": ["deps.edn", "project.clj", "build.clj"],
    "ocaml": ["dune-project", "dune", "*.opam"],
    "julia": ["Project.toml", "Manifest.toml"],
    "nix": ["flake.nix", "default.nix", "shell.nix"],
    "gleam": ["gleam.toml"],
    "vue": ["package.json", "tsconfig.json"],
    "svelte": ["package.json", "tsconfig.json"],
    "astro": ["package.json", "tsconfig.json"],
    "prisma": ["package.json", "tsconfig.json"],
    "typst": ["typst.toml"],
}
# Kinds of symbols.
KINDS = ["Function", "Method", "Class", "Struct", "Enum", "Interface", "Trait", "Type", "Constant", "Variable", "Module", "Import", "Property", "Field"]
TYPE_KINDS = ["Struct", "Enum", "Interface", "Trait", "Type", "Class"]
# Graph labels of a kind.
LABELS = {
    "Function": ["function"], "Method": ["method"], "Struct": ["struct", "type"], "Enum": ["enum", "type"], "Trait": ["trait", "interface"],
    "Class": ["class", "type"], "Interface": ["interface"], "Type": ["type"], "Constant": ["constant"], "Variable": ["variable"],
    "Import": ["import"], "Module": ["module"], "Property": ["property"], "Field": ["field"],
}
# Edge weights.
WEIGHTS = {"contains": 1.0, "imports": 0.5, "implements": 0.8, "calls": 0.3}
# Starts of declaration lines, in lower case.
DECLARATIONS = ["fn ", "pub fn ", "async fn ", "def ", "class ", "struct ", "enum ", "trait ", "impl ", "interface ", "type ", "module ", "mod ", "func ", "function ", "export ", "resource ", "variable ", "locals ", "data "]
# Names before "(" that are not calls.
CALL_KEYWORDS = "if else for while match return let mut fn pub use mod struct enum impl trait type const static where async await loop break continue self super crate as in def class import from with try except raise pass assert yield not and or".split()
# Texts that add one to the complexity of a function.
BRANCHES = ["if ", "if(", "else if", "elif ", "match ", "for ", "for(", "while ", "while(", "loop ", "loop{", "&&", "||", "catch ", "catch(", "case "]
# Comment tags, in order of precedence.
TAGS = ["TODO", "FIXME", "HACK", "XXX", "NOTE", "WARN"]
# File names and extensions of the surfaces of a repository.
BUILD_FILES = ["makefile", "dockerfile", "justfile", "taskfile.yml", "taskfile.yaml", "build.gradle", "build.gradle.kts", "cmakelists.txt", "bazel.build"]
DOC_FILES = ["readme", "readme.md", "readme.mdx", "readme.txt", "changelog", "changelog.md", "contributing", "contributing.md", "code_of_conduct.md", "security.md", "license", "license.md"]
DOC_EXTENSIONS = ["md", "mdx", "rst", "txt", "adoc", "org"]
MANIFESTS = [
    "cargo.toml", "cargo.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "pyproject.toml", "poetry.lock", "go.mod", "go.sum",
    "composer.json", "composer.lock", "rust-toolchain.toml", "rust-toolchain", "tsconfig.json", "vite.config.ts", "vite.config.js", "jest.config.ts", "jest.config.js",
    ".gitignore", ".editorconfig", ".env", ".env.example", "docker-compose.yml", "docker-compose.yaml",
]
CONFIG_EXTENSIONS = ["toml", "json", "yaml", "yml", "ini", "conf"]
# Entry points by file name.
ENTRY_FILES = {
    "lib.rs": "library root", "index.ts": "module index", "index.tsx": "module index", "index.js": "module index", "index.jsx": "module index",
    "app.py": "application entry", "wsgi.py": "application entry", "asgi.py": "application entry", "main.go": "main package",
}
# The 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
