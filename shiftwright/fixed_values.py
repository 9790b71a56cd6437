"""Texts, names and patterns that results must reproduce exactly.

Everything here is data. Rows are in the order in which they are registered or
shown, and no logic depends on their number.
"""

# --- Fixed values: catalogue -------------------------------------------------

# (framework, display name)
FRAMEWORKS = [("angular", "Angular"), ("react", "React")]

# (framework, id, display name, description, default)
MIGRATIONS = [
    (
        "angular",
        "control_flow",
        "Control Flow Syntax",
        "Migrate *ngIf / *ngFor / *ngSwitch to the new @if / @for / @switch syntax (Angular 17+)",
        True,
    ),
    (
        "angular",
        "standalone_components",
        "Standalone Components",
        "Convert NgModule-based components to standalone components with explicit imports (Angular 15+)",
        False,
    ),
    (
        "react",
        "class_to_hooks",
        "Class Components → Hooks",
        "Convert React class components to functional components "
        "using React Hooks (useState, useEffect, useRef, etc.)",
        True,
    ),
    (
        "react",
        "cra_to_vite",
        "Create React App → Vite",
        "Migrate a Create React App project to Vite for faster builds and modern tooling",
        False,
    ),
    (
        "react",
        "router_v5_to_v6",
        "React Router v5 → v6",
        "Migrate from React Router v5 API (Switch, useHistory, Redirect) "
        "to React Router v6 API (Routes, useNavigate, Navigate)",
        False,
    ),
]

# Prefixes that name the framework inside a migration string.
KNOWN_PREFIXES = ["angular", "react", "vue", "nextjs", "python"]

# (framework, migration) -> suffixes; "*" stands for any other migration.
SUFFIXES = {
    ("angular", "control_flow"): [".html"],
    ("angular", "standalone_components"): [".ts"],
    ("angular", "*"): [".html", ".ts"],
    ("react", "cra_to_vite"): [".jsx", ".tsx", ".js", ".ts", ".json"],
    ("react", "*"): [".jsx", ".tsx", ".js", ".ts"],
}

# Suffixes when the caller brings a rule set: word in the migration string -> suffixes.
LEGACY_SUFFIXES = {
    "angular": [".html"],
    "react": [".jsx", ".tsx", ".js", ".ts"],
    "*": [".html", ".ts", ".js"],
}

DEFAULT_SKIP_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv"]

SKIP_DIRS = {
    "angular": [
        "node_modules", ".angular", "dist", ".git", "__pycache__",
        ".venv", "venv", "coverage", "e2e",
    ],
    "react": [
        "node_modules", "dist", "build", ".git", "__pycache__",
        ".venv", "venv", "coverage", ".next", "out",
    ],
}

# Directories the template-text detection does not look into, and the texts it looks for.
DETECT_SKIP_DIRS = ["node_modules", ".git", "dist"]
DETECT_MARKERS = ["*ngIf", "*ngFor", "*ngSwitch", "[(ngModel)]"]

# --- Fixed values: rule patterns (numbered groups, DOTALL, Unicode classes) ----

_ELEMENT = r'(?sU)<([a-zA-Z][\w-]*)([^>]*?){directive}([^>]*?)>(.*?)</\1>'

# (id, description, complexity, has rewrite, required text, attribute pattern)
TEMPLATE_RULES = [
    (
        "ngif_then_else", "*ngIf with then and else template references", "medium", True, "*ngIf=",
        r'\*ngIf="([^";]+);\s*then\s+(\w+);\s*else\s+(\w+)"',
    ),
    (
        "ngif_else", "*ngIf with else template reference", "medium", True, "*ngIf=",
        r'\*ngIf="([^";]+);\s*else\s+(\w+)"',
    ),
    (
        "ngif_async_pipe", "*ngIf with async pipe alias — needs LLM fallback", "ambiguous", False, "*ngIf=",
        r'\*ngIf="([^"]*\|\s*async\s+as\s+\w+[^"]*)"',
    ),
    (
        "ngif_simple", "Simple *ngIf condition", "simple", True, "*ngIf=",
        r'\*ngIf="((?![^"]*\|\s*async\s+as\s+\w+)[^"]+)"',
    ),
    (
        "ngfor_trackby", "*ngFor with trackBy and/or local variable bindings", "medium", True, "*ngFor=",
        r'\*ngFor="let\s+(\w+)\s+of\s+([\w.]+);\s*([^"]+)"',
    ),
    (
        "ngfor_simple", "Simple *ngFor without trackBy", "simple", True, "*ngFor=",
        r'\*ngFor="let\s+(\w+)\s+of\s+([\w.]+)"',
    ),
    (
        "ngswitch", "[ngSwitch] with *ngSwitchCase and *ngSwitchDefault", "medium", True, "[ngSwitch]=",
        r'\[ngSwitch\]="([^"]+)"',
    ),
]


def element_pattern(directive: str) -> str:
    """An element, first closing tag included, whose opening tag holds ``directive``."""
    return _ELEMENT.replace("{directive}", directive)


# The look-ahead of ngif_simple as first published looks to the end of the file.
NGIF_SIMPLE_WIDE_LOOKAHEAD = r'\*ngIf="((?!.*\|\s*async\s+as\s+\w+)[^"]+)"'

# Names an *ngFor microsyntax may bind; each becomes the same name behind a dollar sign.

# --- Fixed values: secret patterns (the first is the known one; the others are
# --- published token formats) --------------------------------------------------

SECRET_RULES = [
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub Token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("Slack Token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Google API Key", r"AIza[0-9A-Za-z_-]{35}"),
    ("Private Key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    (
        "Credential Assignment",
        r"""(?i)(password|passwd|secret|token|api_key|apikey)\s*[:=]\s*["'][0-9A-Za-z_./+=-]{16,}["']""",
    ),
]

# A text without any of these, in lower case, has no match of the rule of that name.
SECRET_NEEDLES = {
    "AWS Access Key": ["akia"],
    "GitHub Token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "Slack Token": ["xox"],
    "Google API Key": ["aiza"],
    "Private Key": ["-----begin "],
    "Credential Assignment": ["password", "passwd", "secret", "token", "api_key", "apikey"],
}

# --- Fixed values: check stages, messages, scores --------------------------------

LEGACY_MARKERS = ["*ngIf=", "*ngFor="]
MSG_LEGACY = "Legacy structural directives still present."
MSG_BRACES = "Unbalanced braces detected."
MSG_MALFORMED_IF = "Malformed @if syntax, missing parentheses."
MSG_ORPHAN = "Orphaned ng-template reference found in output"
WARNING_MARKER = "<!-- WARNING:"

STAGE_SCORES = {"AST": 10.0, "TypeCheck": 15.0, "Lint": 10.0, "VerificationAgent": 5.0}
DETERMINISTIC_SCORE = 40.0
COLLAPSED_SCORE = 40.0
TESTS_SCORE = 20.0
AUTO_APPROVE_THRESHOLD = 90.0
QUICK_REVIEW_THRESHOLD = 70.0
DRY_RUN_DETERMINISTIC = 90.0
DRY_RUN_AMBIGUOUS = 40.0
MAX_RETRIES = 3
MINUTES_PER_FILE = 15
LOG_TAIL = 30
SNIPPET_CHARS = 120

# Failed stage (lower case) -> failure category.
STAGE_CATEGORY = {
    "ast": "syntax_failure",
    "typecheck": "type_error",
    "lint": "lint_error",
    "secretsscan": "secrets_detected",
    "verificationagent": "syntax_failure",
}

SKIPPED_TESTS_LOG = "[SKIPPED] Could not determine test command for this project."
MISSING_PROJECT_LOG = "Project path not found."
SKIPPED_NOTES = {
    ("angular", "TypeCheck"): "[SKIPPED] No tsconfig.json found",
    ("angular", "Lint"): "[SKIPPED] No eslint config found",
    ("react", "TypeCheck"): "[SKIPPED] No tsconfig.json",
}

NG_TEST = ["npx", "ng", "test", "--watch=false"]
NPM_TEST = ["npm", "test"]
NPM_TEST_ONCE = ["npm", "test", "--", "--watchAll=false"]
PYTEST = ["pytest", "--tb=short"]

# --- Fixed values: failure hints -------------------------------------------------

# (framework, migration, category, hint); "*" stands for any other migration.
HINTS = [
    (
        "angular", "control_flow", "syntax_failure",
        "Ensure all @if / @for / @switch blocks have matching opening and closing braces. "
        "Do not leave any *ngIf, *ngFor, or *ngSwitch attributes in the output.",
    ),
    (
        "angular", "control_flow", "type_error",
        "Check that all variable bindings reference properties that exist on the component class. "
        "Prefer using the `as` alias pattern inside @if to ensure type narrowing.",
    ),
    (
        "angular", "control_flow", "lint_error",
        "Ensure consistent indentation (2 spaces), no trailing whitespace, and no unused template variables.",
    ),
    (
        "angular", "control_flow", "secrets_detected",
        "STOP. Do not include any API keys, passwords, tokens, or placeholder credentials in the output. "
        "Never reproduce secrets from context files.",
    ),
    (
        "angular", "control_flow", "test_failure",
        "The transformed template broke at least one behavioral test. Carefully preserve all existing "
        "data bindings, event handlers, and template variables.",
    ),
    (
        "angular", "control_flow", "unknown",
        "Review the full template carefully and ensure the migration is complete and correct.",
    ),
    ("angular", "*", "syntax_failure", "Check syntax carefully after migration."),
    ("angular", "*", "test_failure", "Preserve all existing behavior and data bindings."),
    ("angular", "*", "unknown", "Review the full file carefully."),
    (
        "react", "class_to_hooks", "syntax_failure",
        "Check that all JSX is valid. Ensure the functional component returns exactly one root element. "
        "No `this` keyword should appear.",
    ),
    (
        "react", "class_to_hooks", "type_error",
        "Check TypeScript interfaces and prop types. The functional component props should be typed as: "
        "`function Comp(props: PropType)` or destructured.",
    ),
    (
        "react", "class_to_hooks", "lint_error",
        "Ensure all hooks are called at the top level of the component, not inside conditionals or loops. "
        "Check for missing dependencies in useEffect.",
    ),
    (
        "react", "class_to_hooks", "test_failure",
        "The converted component broke a test. Verify that all event handlers and side effects are preserved. "
        "Check if the component needs forwardRef.",
    ),
    (
        "react", "class_to_hooks", "secrets_detected",
        "Do not include any API keys, tokens, or credentials in the output.",
    ),
    (
        "react", "class_to_hooks", "unknown",
        "Review the converted component carefully for correctness.",
    ),
    ("react", "*", "syntax_failure", "Check JSX syntax carefully."),
    ("react", "*", "test_failure", "Preserve all existing behaviour and prop handling."),
    ("react", "*", "unknown", "Review the migration carefully."),
]

# Used where the framework has no hints at all.
FALLBACK_HINT = "Review the full file carefully and ensure the migration is complete."

# --- Fixed values: prompts ---------------------------------------------------------

# The place of the docs in a system prompt.
DOCS_SLOT = "{context}"
FILE_PROMPT = "Migrate this file:\n"
FAILURE_PROMPT = "\n\nPREVIOUS FAILURE CONTEXT (read carefully before rewriting):\n"

# (framework, migration, system prompt); "*" stands for any other migration.
SYSTEM_PROMPTS = [
    (
        "angular", "control_flow",
        "You are an expert Angular developer. Migrate the provided Angular HTML template to the new "
        "Angular v17+ control flow syntax based on the provided documentation.\n\n"
        "CRITICAL RULES:\n"
        "1. NEVER put @if, @for, or @switch inside HTML tags as attributes.\n"
        "2. The control flow blocks MUST wrap HTML elements, not be inside them.\n"
        "3. Always include a `track` expression in @for blocks.\n"
        "4. Reply ONLY with the rewritten code. Do NOT wrap in markdown code fences.\n\n"
        "DOCS:\n{context}",
    ),
    (
        "angular", "standalone_components",
        "You are an expert Angular developer. Convert the provided Angular component from NgModule-based "
        "to standalone. Follow the Angular 15+ standalone API.\n\n"
        "CRITICAL RULES:\n"
        "1. Add `standalone: true` to the @Component decorator.\n"
        "2. Move all NgModule imports directly into the component's `imports` array.\n"
        "3. Remove NgModule references where the component is declared.\n"
        "4. Reply ONLY with the rewritten code. Do NOT wrap in markdown code fences.\n\n"
        "DOCS:\n{context}",
    ),
    (
        "angular", "*",
        "You are an expert Angular developer. Apply the requested migration based on the provided "
        "documentation.\n\nReply ONLY with the rewritten code.\n\nDOCS:\n{context}",
    ),
    (
        "react", "class_to_hooks",
        "You are an expert React developer specialising in modernising React codebases.\n"
        "Convert the provided React class component to an equivalent functional component using React Hooks.\n\n"
        "CRITICAL RULES:\n"
        "1. Convert ALL lifecycle methods to the correct Hook equivalents.\n"
        "2. Convert `this.state` → `useState`. Each state field becomes its own hook.\n"
        "3. Convert `this.props` → destructured function parameters.\n"
        "4. Remove the class and extend React.Component / PureComponent.\n"
        "5. Keep all business logic and JSX identical — only the structure changes.\n"
        "6. Preserve all TypeScript types/interfaces.\n"
        "7. Reply ONLY with the rewritten code. Do NOT wrap in markdown code fences.\n\n"
        "DOCS:\n{context}",
    ),
    (
        "react", "router_v5_to_v6",
        "You are an expert React developer. Migrate the provided code from React Router v5 to React Router v6.\n\n"
        "CRITICAL RULES:\n"
        "1. Replace <Switch> with <Routes>.\n"
        "2. Replace useHistory() with useNavigate().\n"
        "3. Replace <Redirect> with <Navigate>.\n"
        "4. Update route path matching (exact is now the default in v6).\n"
        "5. Reply ONLY with the rewritten code.\n\n"
        "DOCS:\n{context}",
    ),
    (
        "react", "*",
        "You are an expert React developer. Apply the requested migration based on the provided "
        "documentation.\n\nReply ONLY with the rewritten code. Do NOT wrap in markdown code fences.\n\n"
        "DOCS:\n{context}",
    ),
]

# (framework, migration, order, user text, assistant text)
EXAMPLES = [
    (
        "angular", "control_flow", 1,
        'Migrate this template:\n<div *ngIf="condition">\n  <p>Hello</p>\n</div>',
        "@if (condition) {\n  <div>\n    <p>Hello</p>\n  </div>\n}",
    ),
    (
        "angular", "control_flow", 2,
        'Migrate this template:\n<ul>\n  <li *ngFor="let item of items; trackBy: trackItem">\n'
        "    {{item}}\n  </li>\n</ul>",
        "<ul>\n  @for (item of items; track trackItem($index, item)) {\n    <li>\n      {{item}}\n"
        "    </li>\n  }\n</ul>",
    ),
    (
        "react", "class_to_hooks", 1,
        """Migrate this component:
import React, { Component } from 'react';

class Counter extends Component {
  constructor(props) {
    super(props);
    this.state = { count: 0 };
  }

  componentDidMount() {
    document.title = `Count: ${this.state.count}`;
  }

  render() {
    return (
      <button onClick={() => this.setState({ count: this.state.count + 1 })}>
        {this.state.count}
      </button>
    );
  }
}""",
        """import React, { useState, useEffect } from 'react';

function Counter() {
  const [count, setCount] = useState(0);

  useEffect(() => {
    document.title = `Count: ${count}`;
  }, [count]);

  return (
    <button onClick={() => setCount(count + 1)}>
      {count}
    </button>
  );
}""",
    ),
]

# Fence openings a response may start with; the first that fits is removed.
CODE_FENCES = ["```html", "```jsx", "```tsx", "```typescript", "```ts", "```js", "```"]

# --- Fixed values: report and ticket texts -----------------------------------------

NO_ERRORS = "None"
NO_LOGS = "No tests run / passed."
NO_DIFF = "No changes proposed."
STATUS_APPROVED = "✅ Auto-approved"
STATUS_REVIEW = "⚠️ Review required"
