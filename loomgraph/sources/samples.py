"""A small source in every language, with what is in it: for the query over generated trees and its tests.

``@`` stands for a number.  Nodes: kind, name, line; references: kind, name, line."""

from __future__ import annotations

SAMPLES: dict[str, tuple[str, str, list[tuple[str, str, int]], list[tuple[str, str, int]]]] = {
    "python": ("m@.py", "import os\nclass A@(B@):\n    def go(self):\n        return run@(1)\nLIMIT@ = 3\n", [("import", "os", 1), ("class", "A@", 2), ("method", "go", 3), ("constant", "LIMIT@", 5)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "os", 1)]),
    "go": ("m@.go", 'package m\nimport "fmt"\ntype A@ struct {\n}\nfunc (a *A@) Go() {\n\trun@(1)\n}\n', [("import", "fmt", 2), ("struct", "A@", 3), ("method", "Go", 5)], [("calls", "run@", 6), ("imports", "fmt", 2)]),
    "typescript": ("m@.ts", "import { x } from './x@';\nexport class A@ extends B@ {\n  go(): void {\n    run@(1);\n  }\n}\nconst K@ = 1;\n", [("import", "./x@", 1), ("class", "A@", 2), ("method", "go", 3), ("constant", "K@", 7)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "./x@", 1)]),
    "java": ("A@.java", "import a.X@;\nclass A@ extends B@ implements C@ {\n  int n@ = 1;\n  void go() {\n    run@(new D@());\n  }\n}\n", [("import", "a.X@", 1), ("class", "A@", 2), ("field", "n@", 3), ("method", "go", 4)], [("extends", "B@", 2), ("implements", "C@", 2), ("calls", "run@", 5), ("instantiates", "D@", 5), ("imports", "a.X@", 1)]),
    "kotlin": ("A@.kt", "import a.X@\nclass A@ : B@() {\n  fun go() {\n    run@(1)\n  }\n}\n", [("import", "a.X@", 1), ("class", "A@", 2), ("method", "go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "a.X@", 1)]),
    "scala": ("A@.scala", "import a.X@\nclass A@ extends B@ {\n  def go() = {\n    run@(1)\n  }\n}\n", [("import", "a.X@", 1), ("class", "A@", 2), ("method", "go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "a.X@", 1)]),
    "csharp": ("A@.cs", "using A.X@;\nclass A@ : B@ {\n  public void Go() {\n    run@(new D@());\n  }\n}\n", [("import", "A.X@", 1), ("class", "A@", 2), ("method", "Go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("instantiates", "D@", 4), ("imports", "A.X@", 1)]),
    "fsharp": ("m@.fs", "module A@\nopen X@\nlet go (a) =\n    run@(a)\n", [("module", "A@", 1), ("import", "X@", 2), ("function", "go", 3)], [("calls", "run@", 4), ("imports", "X@", 2)]),
    "ruby": ("m@.rb", "require 'x@'\nclass A@ < B@\n  def go\n    run@(1)\n  end\nend\n", [("import", "x@", 1), ("class", "A@", 2), ("method", "go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "x@", 1)]),
    "rust": ("m@.rs", "use a::X@;\nstruct A@ {\n}\nimpl B@ for A@ {\n  fn go() {\n    run@(1);\n  }\n}\n", [("import", "a::X@", 1), ("struct", "A@", 2), ("method", "go", 5)], [("implements", "B@", 4), ("calls", "run@", 6), ("imports", "a::X@", 1)]),
    "php": ("m@.php", "<?php\nuse A\\X@;\nclass A@ extends B@ {\n  public function go() {\n    run@(1);\n  }\n}\n", [("import", "A\\X@", 2), ("class", "A@", 3), ("method", "go", 4)], [("extends", "B@", 3), ("calls", "run@", 5), ("imports", "A\\X@", 2)]),
    "c": ("m@.c", '#include "x@.h"\nstruct A@ {\n  int n;\n};\nint go(int a) {\n  return run@(a);\n}\n', [("import", "x@.h", 1), ("struct", "A@", 2), ("function", "go", 5)], [("calls", "run@", 6), ("imports", "x@.h", 1)]),
    "cpp": ("m@.cpp", '#include "x@.hpp"\nclass A@ : public B@ {\n};\nvoid A@::go() {\n  run@(1);\n}\n', [("import", "x@.hpp", 1), ("class", "A@", 2), ("method", "go", 4)], [("extends", "B@", 2), ("calls", "run@", 5), ("imports", "x@.hpp", 1)]),
    "objc": ("m@.m", '#import "x@.h"\n@interface A@ : B@\n- (void)go;\n@end\nvoid f@(void) {\n  run@(1);\n}\n'.replace("@interface", "\x00interface").replace("@end", "\x00end"), [("import", "x@.h", 1), ("class", "A@", 2), ("method", "go", 3), ("function", "f@", 5)], [("extends", "B@", 2), ("calls", "run@", 6), ("imports", "x@.h", 1)]),
    "swift": ("m@.swift", "import X@\nclass A@: B@ {\n  func go() {\n    run@(1)\n  }\n}\n", [("import", "X@", 1), ("class", "A@", 2), ("method", "go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "X@", 1)]),
    "dart": ("m@.dart", "import 'x@.dart';\nclass A@ extends B@ {\n  void go() {\n    run@(1);\n  }\n}\n", [("import", "x@.dart", 1), ("class", "A@", 2), ("method", "go", 3)], [("extends", "B@", 2), ("calls", "run@", 4), ("imports", "x@.dart", 1)]),
    "lua": ("m@.lua", "local x = require('x@')\nfunction go(a)\n  return run@(a)\nend\n", [("import", "x@", 1), ("variable", "x", 1), ("function", "go", 2)], [("calls", "run@", 3), ("imports", "x@", 1)]),
    "bash": ("m@.sh", "source x@.sh\ngo() {\n  run@ 1\n}\n", [("import", "x@.sh", 1), ("function", "go", 2)], [("calls", "run@", 3), ("imports", "x@.sh", 1)]),
    "powershell": ("m@.ps1", ". ./x@.ps1\nfunction Go-It@ {\n  Run-It@ 1\n}\n", [("import", "./x@.ps1", 1), ("function", "Go-It@", 2)], [("calls", "Run-It@", 3), ("imports", "./x@.ps1", 1)]),
    "perl": ("m@.pm", "package A@;\nuse X@;\nsub go {\n  run@(1);\n}\n", [("module", "A@", 1), ("import", "X@", 2), ("function", "go", 3)], [("calls", "run@", 4), ("imports", "X@", 2)]),
    "r": ("m@.R", 'source("x@.R")\ngo <- function(a) {\n  run@(a)\n}\n', [("import", "x@.R", 1), ("function", "go", 2)], [("calls", "run@", 3), ("imports", "x@.R", 1)]),
    "julia": ("m@.jl", "using X@\nstruct A@ <: B@\n  r\nend\nfunction go(a)\n  run@(a)\nend\n", [("import", "X@", 1), ("struct", "A@", 2), ("function", "go", 5)], [("extends", "B@", 2), ("calls", "run@", 6), ("imports", "X@", 1)]),
    "elixir": ("m@.ex", "defmodule A@ do\n  alias X@\n  def go(a) do\n    run@(a)\n  end\nend\n", [("module", "A@", 1), ("import", "X@", 2), ("function", "go", 3)], [("calls", "run@", 4), ("imports", "X@", 2)]),
    "erlang": ("m@.erl", '-module(a@).\n-include("x@.hrl").\ngo(A) ->\n    run@(A).\n', [("module", "a@", 1), ("import", "x@.hrl", 2), ("function", "go", 3)], [("calls", "run@", 4), ("imports", "x@.hrl", 2)]),
    "haskell": ("M@.hs", "module A@ where\nimport X@\nclass B@ a where\n  go :: a -> Int\nrun :: Int -> Int\n", [("module", "A@", 1), ("import", "X@", 2), ("interface", "B@", 3), ("method", "go", 4), ("function", "run", 5)], [("imports", "X@", 2)]),
    "sql": ("m@.sql", "CREATE TABLE a@ (\n  id INT,\n  n TEXT\n);\nCREATE VIEW v@ AS SELECT id FROM a@ JOIN b@ ON 1 = 1;\n", [("struct", "a@", 1), ("field", "id", 2), ("field", "n", 3), ("struct", "v@", 5)], [("references", "a@", 5), ("references", "b@", 5)]),
    "go.mod": ("p@/go.mod", "module m@\nrequire (\n  x@ v1.2.0\n  y@ v0.1.0 // indirect\n)\n", [("module", "m@", 1), ("module", "x@", 3), ("module", "y@", 4)], []),
    "package.json": ("p@/package.json", '{"name": "m@",\n"dependencies": {\n"x@": "^1"},\n"devDependencies": {\n"y@": "2"}}\n', [("module", "m@", 1), ("module", "x@", 3), ("module", "y@", 5)], []),
    "artifact": ("p@/README.md", "---\nformat: feature-specification\n---\n# Feature\n### REQ: r@\n**Depends-On:** x@\n", [("feature", "p@", 1), ("requirement", "r@", 5)], [("depends_on", "x@", 6)]),
    "yaml": ("m@.yaml", "a: @\n", [], []),
    "unknown": ("m@.bin", "data\n", [], []),
}


def source(language: str, number: int | str) -> tuple[str, str]:
    """Path and text."""
    path, text, *_ = SAMPLES[language]
    return path.replace("@", str(number)), text.replace("@", str(number)).replace("\x00", "@")
