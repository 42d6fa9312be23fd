"""Fixed word lists and labels. The values below are fixed by what results have to equal."""

# Contractions and their expansions.
CONTRACTIONS = {
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "can't": "cannot", "couldn't": "could not", "won't": "will not", "wouldn't": "would not",
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "shouldn't": "should not",
    "mustn't": "must not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
    "i'm": "i am", "it's": "it is", "that's": "that is", "he's": "he is", "she's": "she is",
    "we're": "we are", "they're": "they are", "you're": "you are", "i've": "i have",
    "we've": "we have", "you've": "you have", "they've": "they have", "let's": "let us",
}

# The public English stopword list of 179 entries, which also are the function words.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he
him his himself she she's her hers herself it it's its itself they them their theirs themselves what
which who whom this that that'll these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won
won't wouldn wouldn't
""".split()

# Labels of the four metrics (key: label, hint, low end, high end).
METRICS = {
    "sentenceLength": ("平均句长", "平均句长：每句话平均多少个词。数值越大句子越长、越书面；越小越短促、越口语化。", "短句", "长句"),
    "simpsonIndex": ("用词重复度", "用词重复度：衡量词汇有多「重复」。数值越高，同一批词反复出现（词汇单调）；越低，用词越多样。", "用词多样", "用词重复"),
    "hapaxLegomena": ("用词新颖度", "用词新颖度：只出现一次的罕见词比例。数值越高，越爱用生僻、独特的新词。", "用词常规", "用词新颖"),
    "functionWords": ("风格走向", "风格走向：用「的、和、是」这类高频小词的用法差异，把文本投成一个风格坐标，看风格像不像。", "风格一端", "风格另一端"),
}
# What stands in for unknown metrics' ends.
OTHER_ENDS = ("低值", "高值")
# Display names.
DISPLAY_NAMES = {
    "The Adventures of Tom Sawyer": "汤姆·索亚历险记",
    "The Adventures of Huckleberry Finn": "哈克贝利·费恩历险记",
    "The Call of the Wild": "野性的呼唤",
    "The call of the wild": "野性的呼唤",
    "White Fang": "白牙",
}
# Words shown where a corpus has fewer than 50 keywords.
DEFAULT_WORDS = ["Literature", "Style", "Twain", "London", "Novel", "Plot", "Character", "Emotion", "Fingerprint", "Text", "Stream", "Galaxy"]
# Style classes by metric, and the words for how steady a series is.
STYLE = {
    "sentence": ("简洁短句风格", "中等句长风格", "复杂长句风格"),
    "simpson": ("词汇多样性高", "词汇多样性中等", "词汇多样性低"),
    "hapax": ("词汇重复度较高", "词汇使用均衡", "词汇独特性强"),
    "function": ("虚词使用模式A", "虚词使用模式B"),
    "other": ("需要进一步分析",),
    "steady": ("波动性大", "中等波动", "风格稳定"),
}
