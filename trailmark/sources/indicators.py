"""The catalogue of persistence indicators.

Fixed values: ids, severities, path globs and patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

AGENT = ("**/CLAUDE.md", "**/CLAUDE.local.md", "**/AGENTS.md", "**/GEMINI.md", "**/.cursorrules", "**/.cursor/rules/*", "**/.github/copilot-instructions.md", "**/.clinerules", "**/.windsurfrules", "**/.roo/rules/*")
CONFIG = ("**/.claude/settings.json", "**/.claude/settings.local.json", "**/.claude/setup.mjs", "**/.cursor/mcp.json", "**/.continue/config.json", "**/.windsurf/mcp.json", "**/.vscode/mcp.json")
WORKFLOW = ("**/.github/workflows/*.yml", "**/.github/workflows/*.yaml")
HOOK = ("**/.git/hooks/pre-commit", "**/.git/hooks/pre-push", "**/.git/hooks/post-checkout", "**/.git/hooks/post-merge", "**/.git/hooks/post-commit", "**/.husky/*", "**/*.sh", "**/*.ps1")
MANIFEST = ("**/package.json",)
SCRIPTS = WORKFLOW + HOOK + CONFIG + MANIFEST

_INSTALL = r'"(?:preinstall|install|postinstall|prepare)"\s*:\s*"[^"]{0,300}'
_REGISTRIES = r"(?!registry\.npmjs\.org|registry\.yarnpkg\.com|npm\.pkg\.github\.com|api\.github\.com|uploads\.github\.com)"


@dataclass(frozen=True)
class Indicator:
    """``patterns`` are looked for line by line in files under ``paths``; an
    indicator without patterns is the path itself.
    """

    id: str
    severity: str
    title: str
    paths: tuple[str, ...]
    patterns: tuple[str, ...] = ()


CATALOGUE = (
    Indicator("agent-instruction-credential-read-directive", "high", "An agent is told to read credentials", AGENT, (
        r"(?i)\b(?:read|open|cat|load|collect|gather|enumerate|inspect)\b[^\n]{0,120}(?:\.npmrc|\.aws/credentials|\.config/gcloud|\.kube/config|\.docker/config\.json|id_rsa|id_ed25519)",
        r"(?i)\b(?:env|environment)\s*(?:vars?|variables?)\b[^\n]{0,80}\b(?:TOKEN|SECRET|PASSWORD|API[_-]?KEY)\b")),
    Indicator("agent-instruction-concealment-directive", "high", "An agent is told to hide what it does", AGENT, (
        r"(?i)\bdo not\s+(?:mention|tell|inform|reveal|disclose|report|log)\b[^\n]{0,80}\b(?:user|human|developer|operator)\b",
        r"(?i)\bwithout\s+(?:mentioning|telling|informing|notifying|asking)\b[^\n]{0,60}\b(?:user|human|developer)\b",
        r"(?i)(?:silently|quietly)\s+(?:collect|gather|read|send|upload|exfiltrate)")),
    Indicator("agent-instruction-shell-download-directive", "high", "An agent is told to run a download", AGENT, (
        r"(?i)\b(?:curl|wget)\b[^\n|]{0,200}\|\s*(?:bash|sh|zsh|dash|node|bun|deno|python3?)\b",
        r"(?i)\b(?:iwr|Invoke-WebRequest|Invoke-RestMethod)\b[^\n|]{0,200}\|\s*(?:iex|Invoke-Expression)\b",
        r"(?i)\bbase64\s+-{1,2}d(?:ecode)?\b[^\n|]{0,120}\|\s*(?:bash|sh|node|bun|python3?)\b")),
    Indicator("agent-instruction-hidden-unicode", "high", "Invisible characters in agent instructions", AGENT, (r"[\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF]",)),
    Indicator("agent-instruction-campaign-marker", "high", "A known campaign's marker", AGENT, (r"(?i)P-2024-001|Universal AI Agent Extraction Framework|ddjidd564\.github\.io",)),
    Indicator("vscode-task-run-on-folder-open", "high", "A task runs when the folder is opened", ("**/.vscode/tasks.json",), (r'(?i)"runOn"\s*:\s*"folderOpen"',)),
    Indicator("agent-config-hook-runs-external-command", "high", "A tool's hook runs an outside command", CONFIG, (
        r'(?i)"command"\s*:\s*"[^"]{0,300}\b(?:curl|wget|base64|iwr|Invoke-Expression|setup\.mjs|setup_bun\.js|bun_environment\.js)\b',
        r'(?i)"(?:args|command)"\s*:\s*(?:\[\s*)?"[^"]{0,200}/\.[a-z0-9_-]{2,40}/[^"/]{0,80}\.(?:js|mjs|cjs|sh)"',
        r"firedalazer|install-mcp-extension|__DAEMONIZED")),
    Indicator("vscode-settings-overrides-toolchain-path", "medium", "Settings point a tool elsewhere", ("**/.vscode/settings.json",), (
        r'(?i)"terminal\.integrated\.(?:automationProfile|automationShell|profiles|shellArgs)[^"]{0,40}"\s*:',
        r'(?i)"[a-z0-9_.-]{0,60}(?:executablePath|defaultInterpreterPath|nodePath|server\.path|\.path)"\s*:\s*"[^"]{0,200}"')),
    Indicator("vscode-workspace-extension-sideload", "medium", "An extension within the workspace", ("**/.vscode/extensions/**",)),
    Indicator("git-hook-runs-external-command", "high", "A hook or script runs a download", HOOK, (
        r"(?i)\b(?:curl|wget)\b[^\n|]{0,200}\|\s*(?:bash|sh|zsh|dash|node|bun|python3?)\b",
        r"(?i)\bbase64\s+-{1,2}d(?:ecode)?\b[^\n|]{0,120}\|\s*(?:bash|sh|node|bun|python3?)\b",
        r"(?i)\b(?:node|bun)\s+(?:run\s+)?(?:\./)?(?:setup_bun\.js|bun_installer\.js|bun_environment\.js|environment_source\.js|setup\.mjs|trap-core\.js|propagate-core\.js)\b")),
    Indicator("install-hook-pipes-download-to-shell", "high", "Installing runs a download", MANIFEST, (
        "(?i)" + _INSTALL + r'\b(?:curl|wget)\b[^"|]{0,200}\|\s*(?:bash|sh|zsh|node|bun|python3?)\b',
        "(?i)" + _INSTALL + r'\b(?:iwr|Invoke-WebRequest)\b[^"|]{0,200}\|\s*(?:iex|Invoke-Expression)\b')),
    Indicator("install-hook-decodes-inline-payload", "high", "Installing decodes a payload", MANIFEST, (
        "(?i)" + _INSTALL + r"(?:base64\s+-{1,2}d|atob\(|Buffer\.from\()", "(?i)" + _INSTALL + r"\b(?:node|bun|deno)\s+-e\b", "(?i)" + _INSTALL + r"\beval\b")),
    Indicator("install-hook-runs-known-worm-loader", "high", "Installing runs a known loader", MANIFEST, (
        r'(?i)"(?:preinstall|install|postinstall|prepare)"\s*:\s*"[^"]{0,120}\b(?:setup_bun\.js|bun_installer\.js|bun_environment\.js|environment_source\.js|setup\.mjs|bundle\.js)"',
        r'(?i)"(?:preinstall|install|postinstall|prepare)"\s*:\s*"bun\s+run\s+index\.js"')),
    Indicator("worm-payload-artifact-present", "high", "A known payload file", ("**/setup_bun.js", "**/bun_installer.js", "**/bun_environment.js", "**/environment_source.js", "**/trap-core.js", "**/propagate-core.js")),
    Indicator("worm-credential-dump-artifact-present", "high", "A known dump of credentials", ("**/actionsSecrets.json", "**/3nvir0nm3nt.json", "**/cl0vd.json", "**/c9nt3nts.json", "**/pigS3cr3ts.json")),
    Indicator("worm-exfil-workflow-present", "high", "A known workflow that sends secrets out", ("**/.github/workflows/shai-hulud-workflow.yml", "**/.github/workflows/shai-hulud-workflow.yaml", "**/.github/workflows/formatter_*.yml", "**/.github/workflows/formatter_*.yaml")),
    Indicator("vendored-secret-scanner-present", "medium", "A secret scanner within the tree", ("**/*trufflehog*", "**/*gitleaks*")),
    Indicator("credential-file-access-in-hook-or-workflow", "high", "A script touches credential files", SCRIPTS, (r"\.npmrc|\.aws/credentials|\.config/gcloud|\.kube/config|\.docker/config\.json|\.ssh/id_rsa|\.ssh/id_ed25519|_authToken",)),
    Indicator("token-exfiltration-to-non-registry-host", "high", "A token goes to a host that is no registry", SCRIPTS, (
        r"\b(?:NPM_TOKEN|NODE_AUTH_TOKEN|GITHUB_TOKEN|GH_TOKEN|AWS_ACCESS_KEY_ID|AWS_SECRET_ACCESS_KEY)\b[^\n]{0,200}https?://" + _REGISTRIES,
        r"https?://" + _REGISTRIES + r"[^\n]{0,200}\b(?:NPM_TOKEN|NODE_AUTH_TOKEN|GITHUB_TOKEN|GH_TOKEN|AWS_SECRET_ACCESS_KEY)\b")),
    Indicator("known-exfiltration-sink-host", "high", "A host known to receive stolen data", SCRIPTS, (
        r"(?i)webhook\[?\.\]?site|requestbin\[?\.\]?com|beeceptor\[?\.\]?com|pipedream\[?\.\]?net|oastify\[?\.\]?com|oast\[?\.\]?fun|discord\[?\.\]?com/api/webhooks",
        r"(?i)npm-cache\[?\.\]?com|pkg-metrics|freefan\[?\.\]?net|fanfree\[?\.\]?net", r"(?i)bb8ca5f6-4175-45d2-b042-fc9ebb8170b7")),
    Indicator("secret-scanner-download-in-hook", "high", "A script fetches or runs a secret scanner", SCRIPTS, (
        r"(?i)\b(?:curl|wget|iwr|Invoke-WebRequest)\b[^\n]{0,200}trufflehog", r"(?i)trufflehog[^\n]{0,120}(?:filesystem|--json|--no-update|--results)", r"(?i)\bgitleaks\s+(?:detect|dir|git)\b")),
    Indicator("cloud-metadata-endpoint-probe", "medium", "A script asks a cloud's metadata service", SCRIPTS, (r"(?i)169\.254\.169\.254|metadata\.google\.internal|metadata\.azure\.com",)),
    Indicator("workflow-dumps-all-secrets", "high", "A workflow dumps all secrets", WORKFLOW, (r"(?i)toJSON\(\s*secrets\s*\)", r"\$\{\{\s*secrets\s*\}\}")),
    Indicator("workflow-self-hosted-worm-runner", "high", "A worm's own runner", WORKFLOW, (r"(?i)SHA1HULUD",)),
    Indicator("workflow-exfiltrates-secret-to-external-host", "high", "A workflow sends a secret out", WORKFLOW, (r"secrets\.[A-Z0-9_]{1,64}[^\n]{0,200}https?://", r"(?i)\b(?:curl|wget)\b[^\n]{0,200}\$\{\{\s*secrets\.")),
    Indicator("workflow-fork-trigger-with-secret-access", "medium", "Forks can trigger a workflow with secrets", WORKFLOW, (r"^\s{0,20}(?:-\s{0,4})?pull_request_target\s{0,4}:?\s{0,4}$",)),
    Indicator("campaign-beacon-string", "high", "A campaign's own words", SCRIPTS, (
        r"(?i)Sha1-Hulud: The Second Coming|Shai-Hulud: Here We Go Again|niagA oG eW ereH :duluH-iahS", r"(?i)Hades - The End for the Damned|Miasma - The Spreading Blight",
        r"(?i)IfYouYankThisTokenItWillNukeTheComputerOfTheOwnerFully|RevokeAndItGoesKaboom", r"(?i)SANDWORM_MODE|ci-quality/code-quality-check")),
)
