"""Word lists, terms and constants of the rules. Results depend on them as they stand."""

# Rules in report order: id, on by default, experimental.
RULES = (
    ("zh-typography-1", True, False),
    ("zh-typography-2", True, False),
    ("zh-typography-3", True, False),
    ("zh-typography-4", True, False),
    ("zh-typography-5", True, False),
    ("zh-typography-6", True, False),
    ("zh-typography-7", True, False),
    ("zh-typography-8", True, False),
    ("zh-typography-9", False, False),
    ("zh-typography-10", True, False),
    ("zh-typography-11", True, False),
    ("zh-tell-1", False, True),
    ("zh-tell-2", False, True),
    ("zh-tell-3", False, True),
    ("zh-tell-4", False, True),
    ("en-tell-1", False, True),
    ("en-tell-2", False, True),
    ("en-tell-3", False, True),
    ("zh-tell-5", False, True),
    ("zh-word-1", False, True),
    ("zh-word-2", False, True),
    ("yaml-frontmatter-1", True, False),
)
FIXABLE = {f"zh-typography-{i}" for i in range(1, 12)} | {"zh-word-1"}

# Units that follow a number with a space, longest first.
UNITS = "kbps Mbps Gbps Tbps KiB MiB GiB TiB PiB bps min kHz MHz GHz dpi fps KB MB GB TB PB ms ns us Hz pt kg mg km cm mm nm".split()

# Abbreviations whose full stops stay.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "cf.", "vs.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."]

# Phrase lists.
PHRASES = {
    "zh-tell-1": "综上所述 总的来说 总而言之 归根结底 值得注意的是 值得一提的是 不难看出 不难发现 众所周知 在这个过程中 从某种意义上说 从某种程度上说 在当今时代 在当今社会 让我们一起 我们可以看到".split(),
    "zh-tell-3": "赋能 抓手 拉通 赛道 心智 颗粒度 组合拳 护城河 打法 破圈 未来可期 拭目以待 高质量发展".split(),
    "zh-tell-4": "希望这对你有帮助 希望对你有帮助 希望这些内容对你有帮助 如果你还有其他问题 如果还有其他问题 如果你有任何其他问题 随时告诉我 需要我帮你 需要我为你 让我们开始吧".split(),
    "en-tell-1": ["tapestry", "tapestries", "testament", "pivotal", "evolving landscape", "diverse array"],
    "en-tell-3": ["load-bearing"],
}
ZERO_ALLOWED = "零成本 零风险 零基础 零门槛 零距离 零容忍 零和 零下 零点 零售 零件 零碎 零散 零食 零钱 零花钱 零工 零头 零星 从零 非零 归零 清零 零信任 零拷贝 零日 零宽 零填充 零值 零位 零字节".split()
SECRET_ALLOWED = "保守秘密 商业秘密 国家秘密".split()

# Terms: wrong, right, anchors.
TERMS = (
    ("秘钥", "密钥", ("secret", "key", "token", "credential", "凭证", "加密")),
    ("代币", "令牌", ("token", "oauth", "jwt", "鉴权", "认证")),
    ("快取", "缓存", ("cache", "cdn", "命中率")),
)
