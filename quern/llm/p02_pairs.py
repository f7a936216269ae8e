"""Problem 2: defective question and answer pairs.

`language` compares the language posteriors of question and answer under a character
n-gram naive Bayes model. `truncated` uses the likelihood, counted over all answers, that
a text's last n-gram is followed by an end. `empty`, `refusal` and `copy` are read off the
two texts. A pair has at most one defect, the first that holds in the order of `DEFECTS`.

Null or blank questions have no language and cannot be copied; questions of fewer than
`MIN_QUESTION` letters ("why?", "求助") carry no language of their own. Copies of a row
come out once. An empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._stats import summed_table
from quern.llm._text import code_points, joined, letters_and_digits, mix64
from quern.sources.tables import table

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

# ---------------------------------------------------------------- language model

# Everyday sentences on which the language model is trained.
SEED_TEXTS = {
    "zh": "今天天气很好，我们一起去公园散步。他说这个问题需要再检查一下，如果明天还有时间，可以先看看结果。医生建议每天按时吃药，并且记录身体的变化。目前没有证据表明这种方法能够改善情况，因此应该继续观察。请您把资料带来，我们会在七天之内给出说明。患者出现不适时，应当及时告诉护理人员。设备启动之后，日志里会显示当前的状态和参数。合同里写明了双方的责任，金额按照实际发生的费用计算。",
    "en": "The weather is fine today and we are going for a walk in the park. He said that the question has to be checked once more, and if there is time tomorrow you can look at the result first. The doctor advises you to take the medicine every day and to record each change. There is no proof so far that this method improves the outcome, so keep watching it. Please bring your papers, we will give an answer within seven days. When the patient feels worse, the nurse should be told at once. After the start, the log shows the current state and its settings. The contract limits what both sides have to pay, and the amount depends on the real cost. I have had this for weeks, should I see someone, and how long will it last?",
    "ja": "今日は天気がとても良いので、みんなで公園を散歩しました。彼はこの問題をもう一度確認する必要があると言いました。明日時間があれば、まず結果を見てください。薬は毎日決まった時間に飲み、体の変化を記録してください。この方法が経過を変えるという根拠はまだありません。資料を持って来てください。症状がひどくなった場合は、すぐに連絡してください。測定値はふだんより少し高めでした。機械を起動すると、画面に現在の状態が表示されます。",
    "ko": "오늘은 날씨가 아주 좋아서 우리는 함께 공원을 산책했습니다. 그는 이 문제를 한 번 더 확인해야 한다고 말했습니다. 내일 시간이 있으면 먼저 결과를 보세요. 약은 매일 정해진 시간에 드시고 몸의 변화를 기록하세요. 이 방법이 경과를 바꾼다는 근거는 아직 없습니다. 자료를 가져오시면 칠 일 안에 답을 드리겠습니다. 증상이 심해지면 바로 연락하세요. 두 번째 측정값은 평소보다 조금 높았습니다.",
    "ru": "Сегодня хорошая погода, и мы идём гулять в парк. Он сказал, что этот вопрос нужно проверить ещё раз, и если завтра будет время, можно сначала посмотреть на результат. Врач советует принимать лекарство каждый день и записывать изменения. Пока нет данных, что этот метод меняет течение болезни, поэтому наблюдение продолжается. Принесите, пожалуйста, документы, мы ответим в течение семи дней. Если жалобы усиливаются, подождите и позвоните. Измерение показало немного больше обычного.",
    "uk": "Сьогодні гарна погода, і ми йдемо гуляти до парку. Він сказав, що це питання треба перевірити ще раз, і якщо завтра буде час, можна спочатку подивитися на результат. Лікар радить приймати ліки щодня і записувати зміни. Поки що немає доказів, що цей метод змінює перебіг хвороби. Принесіть, будь ласка, документи, ми відповімо протягом семи днів. Якщо скарги посилюються, зачекайте і зателефонуйте.",
    "de": "Heute ist das Wetter schön und wir gehen im Park spazieren. Er sagte, dass die Frage noch einmal geprüft werden muss, und wenn morgen Zeit ist, können Sie zuerst das Ergebnis ansehen. Der Arzt rät, das Medikament jeden Tag einzunehmen und jede Veränderung aufzuschreiben. Es gibt bisher keinen Beleg, dass diese Methode den Verlauf ändert, deshalb sollte weiter beobachtet werden. Bitte bringen Sie Ihre Unterlagen mit, wir antworten innerhalb von sieben Tagen. Wenn die Beschwerden zunehmen, warten Sie einige Stunden und rufen Sie an. Der Messwert lag etwas höher als üblich.",
    "nl": "Het weer is vandaag mooi en we gaan wandelen in het park. Hij zei dat de vraag nog een keer gecontroleerd moet worden, en als er morgen tijd is kunt u eerst naar de uitslag kijken. De arts raadt aan het middel elke dag in te nemen en elke verandering op te schrijven. Er is nog geen bewijs dat deze methode het verloop verandert. Neem uw papieren mee, we geven binnen zeven dagen antwoord. Als de klachten erger worden, wacht dan enkele uren en bel ons. De meetwaarde was iets hoger dan gewoonlijk.",
    "fr": "Il fait beau aujourd'hui et nous allons nous promener dans le parc. Il a dit que la question doit être vérifiée encore une fois, et si vous avez le temps demain, vous pouvez d'abord regarder le résultat. Le médecin conseille de prendre le médicament chaque jour et de noter les changements. Il n'y a pas de preuve que cette méthode change l'évolution, il faut donc continuer à observer. Veuillez apporter vos papiers, nous répondrons dans les sept jours. Si la gêne augmente, attendez quelques heures et appelez le service. La deuxième mesure était un peu plus élevée que d'habitude.",
    "es": "Hoy hace buen tiempo y vamos a pasear por el parque. Dijo que la pregunta se debe revisar otra vez, y si mañana hay tiempo, puede mirar primero el resultado. El médico aconseja tomar la medicina cada día y anotar los cambios. No hay pruebas de que este método cambie el curso de la enfermedad, así que conviene seguir observando. Por favor traiga sus papeles, responderemos en siete días. Si la molestia aumenta, conviene esperar unas horas y llamar al servicio. El paciente debe saber que la segunda lectura fue algo superior a lo habitual.",
    "pt": "Hoje o tempo está bom e vamos passear no parque. Ele disse que a pergunta deve ser verificada mais uma vez, e se amanhã houver tempo, você pode olhar primeiro o resultado. O médico aconselha tomar o remédio todos os dias e anotar as mudanças. Ainda não há provas de que este método mude o curso da doença, por isso convém continuar a observar. Traga os seus papéis, por favor, responderemos em sete dias. Se o incômodo aumentar, espere algumas horas e ligue. A segunda leitura foi um pouco maior que o habitual.",
    "it": "Oggi il tempo è bello e andiamo a passeggiare nel parco. Ha detto che la domanda deve essere controllata ancora una volta, e se domani c'è tempo, può guardare prima il risultato. Il medico consiglia di prendere la medicina ogni giorno e di annotare i cambiamenti. Non ci sono prove che questo metodo cambi il decorso, quindi conviene continuare a osservare. Porti per favore i suoi documenti, risponderemo entro sette giorni. Se il disturbo aumenta, aspetti qualche ora e chiami il servizio. La seconda misura era un po' più alta del solito.",
    "vi": "Hôm nay trời đẹp và chúng tôi đi dạo trong công viên. Anh ấy nói rằng câu hỏi này cần được kiểm tra lại một lần nữa, và nếu ngày mai có thời gian thì bạn có thể xem kết quả trước. Bác sĩ khuyên nên uống thuốc mỗi ngày và ghi lại những thay đổi. Cho đến nay chưa có bằng chứng cho thấy phương pháp này làm thay đổi diễn biến của bệnh, vì vậy nên tiếp tục theo dõi. Xin vui lòng mang theo giấy tờ, chúng tôi sẽ trả lời trong vòng bảy ngày. Nếu khó chịu tăng lên, hãy chờ vài giờ rồi gọi điện.",
    "tr": "Bugün hava güzel ve parkta yürüyüşe çıkıyoruz. Bu sorunun bir kez daha kontrol edilmesi gerektiğini söyledi, yarın vaktiniz olursa önce sonuca bakabilirsiniz. Doktor ilacı her gün almanızı ve değişiklikleri not etmenizi öneriyor. Bu yöntemin hastalığın gidişini değiştirdiğine dair henüz bir kanıt yok, bu yüzden izlemeye devam edilmeli. Lütfen belgelerinizi getirin, yedi gün içinde cevap vereceğiz. Şikayetler artarsa birkaç saat bekleyin ve bizi arayın. İkinci ölçüm her zamankinden biraz daha yüksekti.",
    "pl": "Dzisiaj jest ładna pogoda i idziemy na spacer do parku. Powiedział, że to pytanie trzeba sprawdzić jeszcze raz, a jeśli jutro będzie czas, można najpierw spojrzeć na wynik. Lekarz zaleca przyjmować lek codziennie i zapisywać zmiany. Nie ma jeszcze dowodów, że ta metoda zmienia przebieg choroby, dlatego należy dalej obserwować. Proszę przynieść dokumenty, odpowiemy w ciągu siedmiu dni. Jeśli dolegliwości się nasilą, proszę poczekać kilka godzin i zadzwonić.",
    "id": "Hari ini cuaca cerah dan kami berjalan-jalan di taman. Dia mengatakan bahwa pertanyaan ini perlu diperiksa sekali lagi, dan jika besok ada waktu, Anda dapat melihat hasilnya terlebih dahulu. Dokter menyarankan untuk minum obat setiap hari dan mencatat perubahan. Belum ada bukti bahwa cara ini mengubah perjalanan penyakit, jadi sebaiknya terus diamati. Silakan bawa surat-surat Anda, kami akan menjawab dalam tujuh hari. Jika keluhan bertambah, tunggu beberapa jam lalu hubungi kami.",
    "ar": "الطقس جميل اليوم ونحن ذاهبون للمشي في الحديقة. قال إن السؤال يجب أن يراجع مرة أخرى، وإذا كان هناك وقت غدا يمكنك أن تنظر أولا إلى النتيجة. ينصح الطبيب بتناول الدواء كل يوم وتسجيل كل تغير. لا يوجد دليل حتى الآن على أن هذه الطريقة تغير مسار المرض. من فضلك أحضر أوراقك وسنجيب خلال سبعة أيام. إذا زادت الشكوى فانتظر بضع ساعات ثم اتصل.",
}
LANGUAGES = tuple(SEED_TEXTS)
FEATURES = 1 << 14
MIN_QUESTION = 12
#: Nats by which the answer's language must beat the question's before a pair is flagged.
MARGIN = 12.0


def _lowered(points: np.ndarray) -> np.ndarray:
    """Lower case for Latin, Greek and Cyrillic; what is no letter becomes a space."""
    p = points.astype(np.uint32, copy=True)
    upper = ((p >= 65) & (p <= 90)) | ((p >= 0xC0) & (p <= 0xDE) & (p != 0xD7)) | ((p >= 0x410) & (p <= 0x42F))
    p[upper] += 32
    wide = (p >= 0xFF21) & (p <= 0xFF5A)
    p[wide] -= 0xFEE0
    other = (p < 97) | ((p > 122) & (p < 0xC0)) | ((p >= 0x2000) & (p < 0x3041)) | ((p >= 0xFF00) & (p < 0xFF66))
    p[other] = 32
    return p


def features(points: np.ndarray) -> np.ndarray:
    """One feature per position, -1 at spaces: the character in scripts without word spaces, else the character trigram ending there."""
    p = _lowered(points)
    before = np.empty_like(p)
    before[0:1], before[1:] = 32, p[:-1]
    first = np.empty_like(p)
    first[0:2], first[2:] = 32, p[:-2]
    first[before == 32] = 32
    spaceless = p >= 0x2E80
    h = np.where(spaceless, p.astype(np.uint64), ((p.astype(np.uint64) << np.uint64(16) | before) << np.uint64(16)) | first)
    out = (mix64(h) >> np.uint64(50)).astype(np.int32)
    out[p == 32] = -1
    return out


def train_languages(texts: dict[str, str] = SEED_TEXTS) -> np.ndarray:
    """Log likelihoods (FEATURES + 1, languages), add-0.1 smoothed; the last row is for spaces and holds zeros."""
    weights = np.zeros((FEATURES + 1, len(texts)), dtype=np.float32)
    for k, text in enumerate(texts.values()):
        f = features(code_points(text))
        counts = np.bincount(f[f >= 0], minlength=FEATURES) + 0.1
        weights[:FEATURES, k] = np.log(counts / counts.sum())
    return weights


def language_scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language, and the letters it has."""
    scores, letters = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), dtype=np.int64)
    points, starts = joined(texts)
    step = 1 << 18  # features scored at once, so that memory does not follow the longest text
    f = features(points)
    f[starts[1:] - 1] = -1
    for a in range(0, len(f), step):
        part = f[a : a + step]
        has = np.flatnonzero(part >= 0)
        owner = np.searchsorted(starts, has + a, side="right") - 1
        if len(has):
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            scores[owner[cuts]] += np.add.reduceat(weights[part[has]], cuts, axis=0)
            letters[owner[cuts]] += np.diff(np.r_[cuts, len(owner)])
    return scores, letters


# ---------------------------------------------------------------- end-of-text model

#: Orders of the n-grams and the bits of each order's hashed table; OFFSETS are in counters.
ORDERS, BITS = (3, 5, 8), (17, 18, 19)
#: Each order has two tables under two hashes; the smaller count is the less disturbed one.
OFFSETS = (0, *np.cumsum([4 << b for b in BITS]).tolist())
#: The longest n-gram that occurs clearly more often than a bucket fills by chance decides
#: (FLOOR times, and at least SUPPORT times); an end is sound from this share of ends on.
FLOOR, SUPPORT, SOUND = 2.5, 6, 0.3
# Signs that end a sentence, and white space.
ENDERS = "。！？!?…；;"
WHITE = " \t\r\n\x00　"


def _context_hashes(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position p the two buckets of the ORDERS[k] code points before it (positions below that are wrong)."""
    n = ORDERS[k]
    h = np.full(len(points) + 1, n, dtype=np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    for j in range(n, 0, -1):
        h *= m
        h[j:] += points[: len(points) - j + 1]
    h = mix64(h)
    return (h >> np.uint64(64 - BITS[k])).astype(np.int64), (h & np.uint64((1 << BITS[k]) - 1)).astype(np.int64)


def _unified(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of digits as one sign; also which positions (after each code point, and 0) are kept."""
    p = points.astype(np.uint64)
    digit = (p >= 48) & (p <= 57)
    p[digit] = 48
    keep = ~(digit & np.r_[digit[1:], False])
    return p[keep], np.r_[True, keep]


def _ends_after(points: np.ndarray) -> np.ndarray:
    """end[p]: a sentence, line or text ends between p-1 and p."""
    n = len(points)
    stop = np.isin(points, code_points(ENDERS + "\n\x00"))
    white = np.isin(points, code_points(WHITE))
    dot = points == 46
    after = np.zeros(n + 1, dtype=bool)
    after[n] = True
    after[:n] = stop
    after[: n - 1] |= dot[:-1] & white[1:]
    after[1:n] |= dot[:-1] & white[1:]
    return after


def _fill_ends(batch: pa.RecordBatch, counts: np.ndarray) -> None:
    texts = [t for t in batch.column(0).to_pylist() if t]
    if not texts:
        return
    points, _ = joined(texts)
    step, reach = 1 << 21, max(ORDERS)
    for a in range(0, len(points), step):
        lead = min(a, reach)
        part = points[a - lead : a + step + 2]
        p, keep = _unified(part)
        ends = _ends_after(part)[keep]
        lead, stop = int(keep[1 : lead + 1].sum()), int(keep[1 : lead + step + 1].sum())
        for k, n in enumerate(ORDERS):
            size, first = 1 << BITS[k], max(n, lead)
            for j, h in enumerate(_context_hashes(p, k)):
                h, at = h[first:stop], OFFSETS[k] + 2 * j * size
                counts[at : at + size] += np.bincount(h, minlength=size)
                counts[at + size : at + 2 * size] += np.bincount(h[ends[first:stop]], minlength=size)


def end_counts(answers: DataFrame) -> np.ndarray:
    """For each order, how often each hashed n-gram occurs in all answers, then how often an end follows it."""
    return summed_table(answers, _fill_ends, OFFSETS[-1])


def end_likelihood(text: str, counts: np.ndarray) -> float:
    """Share of the longest supported last n-gram's other occurrences that an end follows."""
    p, _ = _unified(code_points(text[-64:]))
    total = counts[: 1 << BITS[0]].sum() if not isinstance(counts, tuple) else counts[1]
    table_ = counts[0] if isinstance(counts, tuple) else counts
    for k in range(len(ORDERS) - 1, -1, -1):
        n, size = ORDERS[k], 1 << BITS[k]
        if len(p) >= n:
            at = [OFFSETS[k] + 2 * j * size + int(h[n]) for j, h in enumerate(_context_hashes(p[-n:], k))]
            seen, ended = min(int(table_[b]) for b in at) - 1, min(int(table_[b + size]) for b in at) - 1
            if seen >= max(SUPPORT, FLOOR * total / size) or k == 0:
                return max(0.0, ended / seen) if seen > 0 else 0.0
    return 0.0


# ---------------------------------------------------------------- rules on the two texts

# Words that stand for "nothing here", after NFKC, lower case and without signs.
NOTHING = frozenset("无 略 空 暂无 没有 暂缺 缺 待补 待补充 待定 暂无内容 无内容 暂无答案 无答案 暂无回答 未填写 未填 空白 none null nil nan na n a nothing empty blank tbd todo noanswer noanswer missing undefined なし".split())
# Patterns by which a sentence declines, and courtesies that may go with it.
DECLINES = re.compile(
    r"无法(?:回答|提供|给出|协助|帮|满足|处理|解答)|不能(?:提供|回答|给出|协助|解答|讨论)|不便(?:作答|讨论|回答|透露|提供)|不方便(?:讨论|作答|回答|提供)|帮不上忙|帮不了|超出了?我的|没有足够的信息|恕我|恕不|拒绝回答|难以(?:回答|作答)|不予回答|爱莫能助"
    r"|(?:作为|我是|我只是)(?:一个|一名)?(?:语言模型|智能助手|人工智能|助手|AI)"
    r"|\b(?:can ?not|can't|can’t|could not|unable to|not able to|won't|will not|must decline|have to decline|decline to|refuse to|not allowed to|not in a position)\b.{0,40}\b(?:help|assist|answer|provide|give|discuss|comment|respond|advi[sc]e|request|question|do that)\b|\bdecline to\b|\bunable to (?:help|answer|give|provide)\b|\bas an? (?:assistant|ai|language model)\b|\b(?:beyond|outside) (?:my|what i)\b|\bnot enough information\b|\bdo(?:n't| not) have (?:enough )?information\b",
    re.I,
)
COURTESY = re.compile(
    r"抱歉|对不起|不好意思|谢谢|感谢|请(?:咨询|前往|联系|谅解|见谅|换|到|向|您)|建议(?:您|你)?(?:换|咨询|前往|联系|向)|见谅|谅解|理解"
    r"|\b(?:sorry|apolog|unfortunately|regret|thank|please|try (?:another|a different|again)|ask a|consult|contact|see a|understanding)\b",
    re.I,
)
_WORDS, _MARKS = re.compile(r"[^\W_]+"), re.compile(r"[\u0300-\u036f\u1161-\u11ff\u3099\u309a\uff9e\uff9f]")
_SENTENCES = re.compile(r"[。！？!?\n\r；;]+|(?<=[a-z])\.(?=\s|$)")
_CLAUSES = re.compile(r"[，,]|\s-\s")
_LIST_NUMBER = re.compile(r"(?:^|[\n\r])[ \t　]*(?:[(（]?\d{1,3}[)）.、．:：]|第?[一二三四五六七八九十]{1,3}[、.．)）]|[-*•·●▪])[ \t　]*$")
_NEEDS_MORE = "，、：（(《〈“‘「『【[{,:-–—/&+=＝～~"
_PAIRS = {"）": "（", ")": "(", "”": "“", "’": "‘", "」": "「", "』": "『", "》": "《", "】": "【", "]": "["}


def is_empty(answer: str | None) -> bool:
    """Null, blank, only signs, or a word for "nothing here"."""
    if answer is None or len(answer) > 40:
        return answer is None or not answer.strip() or not letters_and_digits(answer[:4000]) and not letters_and_digits(answer)
    kept = letters_and_digits(answer)
    return not kept or kept in NOTHING


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is a courtesy, at least one declines, and nothing else is said."""
    if not DECLINES.search(answer):
        return False
    declined = False
    for sentence in _SENTENCES.split(answer):
        if not sentence or not sentence.strip():
            continue
        if DECLINES.search(sentence):
            declined = True
            # a long clause beside the declining one is content of its own
            if any(len(c) > (90 if c.isascii() else 26) and not DECLINES.search(c) for c in _CLAUSES.split(sentence)):
                return False
        elif not COURTESY.search(sentence) or len(sentence) > (90 if sentence.isascii() else 30):
            return False
    return declined


def is_copy(question: str, answer: str) -> bool:
    """The answer's runs of three letters are the question's, save a lead-in, and cover most of it."""
    q = letters_and_digits(question)
    # each code point gives a letter at least, unless it is a sign or a space: a quick bound before the answer is normalised
    if len(q) < 6 or len(answer) > 3 * len(question) + 120 and sum(map(len, _WORDS.findall(answer))) > 2 * len(q) + 60 + len(_MARKS.findall(answer)):
        return False
    a = letters_and_digits(answer)
    if not 0.6 * len(q) <= len(a) <= 2 * len(q) + 60:
        return False
    grams = {q[k : k + 3] for k in range(len(q) - 2)}
    known = [a[k : k + 3] in grams for k in range(len(a) - 2)]
    if True not in known:
        return False
    first = known.index(True)
    if first > (45 if a.isascii() else 16) or known[first:].count(False) > 6:
        return False
    return len({a[k : k + 3] for k in range(len(a) - 2)} & grams) >= 0.6 * len(grams)


def is_truncated(answer: str, counts: np.ndarray) -> bool:
    """Ends at a list number, at a sign that needs a continuation, in an open bracket, or after an n-gram that no end follows."""
    text = answer.rstrip(" \t\r\n　")
    if not text:
        return False
    if _LIST_NUMBER.search(text):
        return True
    if text.rstrip("”’」』）)\"'")[-1:] in tuple("。！？!?") and text[-1] not in "。！？!?":
        return False  # a finished sentence inside closing signs
    last = text[-1]
    if last in _NEEDS_MORE:
        return True
    if last == "…" or text.endswith("..."):
        body = text.rstrip("….")
        return not body or body[-1] not in "。！？!?"
    if last in ENDERS and last not in ";；" or last == "." and not text[-2:-1].isdigit():
        return False
    if last in ";；":
        return True
    tail = text[text.rfind("\n") + 1 :]  # the last line, however long
    for close, opened in _PAIRS.items():
        if tail.rfind(opened) > tail.rfind(close) and opened in "（(“「『《【":
            return True
    return end_likelihood(text, counts) < SOUND


def _wholly_other(answer: str, question_language: int, weights: np.ndarray) -> bool:
    """No sentence of some length is in the question's language."""
    parts = [s for s in re.split(r"[。！？!?\n]+|\.\s", answer) if len(s) >= 12]
    if not parts:
        return True
    scores, letters = language_scores(parts, weights)
    same = scores.argmax(axis=1) == question_language
    return letters[same].sum() <= 0.1 * letters.sum()


def _flag(weights, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = weights.value, counts.value
        c = (c, c[: 1 << BITS[0]].sum())
        for batch in batches:
            ids, questions, answers = (batch.column(k).to_pylist() for k in range(3))
            found: dict[int, str] = {}
            rest = []
            for k, (q, a) in enumerate(zip(questions, answers)):
                if is_empty(a):
                    found[k] = "empty"
                elif is_refusal(a):
                    found[k] = "refusal"
                elif q and is_copy(q, a):
                    found[k] = "copy"
                else:
                    rest.append(k)
            qs, ql = language_scores([questions[k] or "" for k in rest], w)
            as_, al = language_scores([answers[k] for k in rest], w)
            best_q, best_a = qs.argmax(axis=1), as_.argmax(axis=1)
            row = np.arange(len(rest))
            lead = as_[row, best_a] - as_[row, best_q]
            sure_q = qs[row, best_q] - (qs + np.where(np.arange(qs.shape[1]) == best_q[:, None], -np.inf, 0)).max(axis=1) if len(rest) else np.zeros(0)
            other = (best_q != best_a) & (ql >= MIN_QUESTION) & (al >= 8) & (lead >= MARGIN) & (sure_q >= MARGIN / 2)
            for j, k in enumerate(rest):
                if other[j] and _wholly_other(answers[k], best_q[j], w):
                    found[k] = "language"
                elif is_truncated(answers[k], c):
                    found[k] = "truncated"
            keep = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([found[k] for k in keep], pa.string())], ["id", "defect"])

    return run


def pair_defects(pairs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(id, defect) of the defective rows of `pairs(id, question, answer)`, one row each.

    The end-of-text model counts `answers(answer)`, by default those of `pairs`.
    """
    pairs = pairs.select(F.col("id").cast("long").alias("id"), "question", "answer")
    spark = pairs.sparkSession
    counts = spark.sparkContext.broadcast(end_counts((pairs if answers is None else answers).select("answer")))
    weights = spark.sparkContext.broadcast(train_languages())
    flagged = pairs.mapInArrow(_flag(weights, counts), "id long, defect string")
    return flagged.groupBy("id").agg(F.min("defect").alias("defect"))


def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "format_data", ["id", "question", "answer"])
    b = table(spark, folder, "deepseek_qa", ["qa_id", "question", "answer"]).withColumnRenamed("qa_id", "id")
    return a.unionByName(b)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of both tables."""
    return pair_defects(all_pairs(spark, folder))


def p2_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by kind of defect."""
    return p2_found(spark, folder).groupBy("defect").agg(F.count("*").alias("pairs"))


QUERIES = {"p2_found": p2_found, "p2_kinds": p2_kinds}
ORACLES: dict[str, str] = {}
