"""Agent profiles shipped with the package."""

# Process names, folders and domains of known agents, in match order.
BUILTIN_PROFILES = [
    {
        "id": "aider",
        "name": "Aider",
        "vendor": "Paul Gauthier",
        "process": {
            "names": ["aider"],
            "exe": ["**/aider", "aider"],
            "cmdline_contains": ["aider"],
        },
        "data_dirs": ["~/.aider", "~/.config/aider"],
        "config_files": ["~/.aider.conf.yml", "~/.aider.model.settings.yml"],
        "allowed_domains": ["openrouter.ai", "*.openrouter.ai", "*.openai.com", "*.anthropic.com", "*.googleapis.com", "*.deepseek.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "claude-code",
        "name": "Claude Code",
        "vendor": "Anthropic",
        "process": {
            "names": ["claude"],
            "exe": ["**/claude", "claude", "**/.claude/local/claude", "**/claude-code/**"],
            "cmdline_contains": ["@anthropic-ai/claude-code", "claude-code/cli.js"],
        },
        "data_dirs": ["~/.claude"],
        "config_files": ["~/.claude.json", "~/.claude/settings.json", "~/.claude/settings.local.json"],
        "allowed_domains": ["*.anthropic.com", "anthropic.com", "claude.ai"],
        "telemetry_domains": ["*.sentry.io", "*.statsig.com"],
    },
    {
        "id": "codex-cli",
        "name": "Codex CLI",
        "vendor": "OpenAI",
        "process": {
            "names": ["codex"],
            "exe": ["**/codex", "codex", "**/@openai/codex/**"],
            "cmdline_contains": ["@openai/codex"],
        },
        "data_dirs": ["~/.codex"],
        "config_files": ["~/.codex/config.toml", "~/.codex/auth.json"],
        "allowed_domains": ["*.openai.com", "openai.com", "chatgpt.com", "*.oaistatic.com", "*.oaiusercontent.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "command-code",
        "name": "Command Code",
        "vendor": "Command Code",
        "process": {
            "names": ["command-code", "cmd"],
            "exe": ["**/command-code/**", "**/command-code"],
            "cmdline_contains": ["command-code", "commandcode"],
        },
        "data_dirs": ["~/.commandcode"],
        "config_files": ["~/.commandcode/config.json"],
        "allowed_domains": ["*.commandcode.ai", "commandcode.ai"],
        "telemetry_domains": [],
    },
    {
        "id": "copilot-cli",
        "name": "GitHub Copilot CLI",
        "vendor": "GitHub",
        "process": {
            "names": ["copilot"],
            "exe": ["**/copilot", "copilot"],
            "cmdline_contains": ["@github/copilot"],
        },
        "data_dirs": ["~/.copilot", "~/.config/github-copilot"],
        "allowed_domains": ["*.githubcopilot.com", "api.github.com", "github.com", "*.githubusercontent.com", "*.github.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "crush",
        "name": "Crush",
        "vendor": "Charm",
        "process": {
            "names": ["crush"],
            "exe": ["**/crush", "crush"],
        },
        "data_dirs": ["~/.config/crush", "~/.local/share/crush"],
        "config_files": ["~/.config/crush/crush.json"],
        "allowed_domains": ["*.anthropic.com", "*.openai.com", "openrouter.ai", "*.googleapis.com", "*.groq.com", "*.deepseek.com"],
        "telemetry_domains": ["*.charm.sh"],
    },
    {
        "id": "cursor-agent",
        "name": "Cursor Agent CLI",
        "vendor": "Anysphere",
        "process": {
            "names": ["cursor-agent", "Cursor"],
            "exe": ["**/cursor-agent", "cursor-agent", "**/Cursor.app/Contents/MacOS/**"],
            "cmdline_contains": ["cursor-agent"],
        },
        "data_dirs": ["~/.cursor", "~/Library/Application Support/Cursor", "~/.cursor-server"],
        "config_files": ["~/.cursor/cli-config.json"],
        "allowed_domains": ["*.cursor.sh", "cursor.sh", "*.cursor.com", "cursor.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "droid",
        "name": "Droid",
        "vendor": "Factory AI",
        "process": {
            "names": ["droid"],
            "exe": ["**/droid", "droid"],
            "cmdline_contains": ["@factory-ai/droid"],
        },
        "data_dirs": ["~/.factory"],
        "config_files": ["~/.factory/config.json"],
        "allowed_domains": ["*.factory.ai", "factory.ai", "app.factory.ai"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "gemini-cli",
        "name": "Gemini CLI",
        "vendor": "Google",
        "process": {
            "names": ["gemini"],
            "exe": ["**/gemini", "gemini"],
            "cmdline_contains": ["@google/gemini-cli"],
        },
        "data_dirs": ["~/.gemini"],
        "config_files": ["~/.gemini/settings.json"],
        "allowed_domains": ["cloudcode-pa.googleapis.com", "generativelanguage.googleapis.com", "*.googleapis.com", "accounts.google.com", "oauth2.googleapis.com", "*.googleusercontent.com"],
        "telemetry_domains": ["*.google-analytics.com", "play.google.com"],
    },
    {
        "id": "goose",
        "name": "Goose",
        "vendor": "Block",
        "process": {
            "names": ["goose"],
            "exe": ["**/goose", "goose"],
        },
        "data_dirs": ["~/.config/goose", "~/.local/share/goose"],
        "config_files": ["~/.config/goose/config.yaml"],
        "allowed_domains": ["*.anthropic.com", "*.openai.com", "*.googleapis.com", "openrouter.ai", "*.block.xyz"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "iflow-cli",
        "name": "iFlow CLI",
        "vendor": "心流 AI",
        "process": {
            "names": ["iflow"],
            "exe": ["**/iflow", "iflow"],
            "cmdline_contains": ["@iflow-ai/iflow-cli", "iflow-cli"],
        },
        "data_dirs": ["~/.iflow"],
        "config_files": ["~/.iflow/settings.json"],
        "allowed_domains": ["*.iflow.cn", "iflow.cn", "platform.iflow.cn"],
        "telemetry_domains": [],
    },
    {
        "id": "kiro",
        "name": "Kiro",
        "vendor": "AWS",
        "process": {
            "names": ["Kiro", "kiro"],
            "exe": ["**/Kiro.app/Contents/MacOS/**", "**/kiro-cli"],
        },
        "data_dirs": ["~/Library/Application Support/Kiro", "~/.kiro"],
        "allowed_domains": ["*.kiro.dev", "kiro.dev", "*.amazonaws.com", "*.aws.dev", "*.awsapps.com", "*.amazon.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "opencode",
        "name": "OpenCode",
        "vendor": "SST",
        "process": {
            "names": ["opencode"],
            "exe": ["**/opencode", "opencode"],
        },
        "data_dirs": ["~/.local/share/opencode", "~/.config/opencode"],
        "config_files": ["~/.config/opencode/opencode.json"],
        "allowed_domains": ["*.anthropic.com", "*.openai.com", "openrouter.ai", "*.openrouter.ai", "*.googleapis.com", "*.githubcopilot.com", "models.dev"],
        "telemetry_domains": [],
    },
    {
        "id": "qwen-code",
        "name": "Qwen Code",
        "vendor": "Alibaba",
        "process": {
            "names": ["qwen"],
            "exe": ["**/qwen", "qwen"],
            "cmdline_contains": ["@qwen-code/qwen-code", "qwen-code"],
        },
        "data_dirs": ["~/.qwen"],
        "config_files": ["~/.qwen/settings.json"],
        "allowed_domains": ["dashscope.aliyuncs.com", "dashscope-intl.aliyuncs.com", "*.aliyuncs.com", "portal.qwen.ai", "*.qwen.ai"],
        "telemetry_domains": [],
    },
    {
        "id": "trae",
        "name": "Trae",
        "vendor": "ByteDance",
        "process": {
            "names": ["Trae", "trae"],
            "exe": ["**/Trae.app/Contents/MacOS/**", "**/trae"],
        },
        "data_dirs": ["~/Library/Application Support/Trae", "~/.trae"],
        "allowed_domains": ["*.trae.ai", "trae.ai", "*.trae.com.cn", "trae.com.cn"],
        "telemetry_domains": [],
    },
    {
        "id": "windsurf",
        "name": "Windsurf",
        "vendor": "Codeium",
        "process": {
            "names": ["Windsurf", "windsurf"],
            "exe": ["**/Windsurf.app/Contents/MacOS/**", "**/windsurf"],
        },
        "data_dirs": ["~/Library/Application Support/Windsurf", "~/.codeium", "~/.windsurf"],
        "allowed_domains": ["*.codeium.com", "codeium.com", "*.windsurf.com", "windsurf.com"],
        "telemetry_domains": ["*.sentry.io"],
    },
    {
        "id": "zcode",
        "name": "ZCode",
        "vendor": "智谱 AI",
        "process": {
            "names": ["zcode", "ZCode"],
            "exe": ["**/ZCode.app/Contents/MacOS/**", "**/zcode", "zcode"],
        },
        "data_dirs": ["~/Library/Application Support/ZCode", "~/Library/Logs/ZCode", "~/.zcode"],
        "config_files": ["~/Library/Application Support/ZCode/config.json"],
        "allowed_domains": ["*.z.ai", "z.ai", "open.bigmodel.cn", "*.bigmodel.cn", "*.zhipuai.cn", "chatglm.cn"],
        "telemetry_domains": [],
    },
]
