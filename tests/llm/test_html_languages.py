"""Pages without an article element in many languages, attributes that only look like marks, and the two passes by plain loops."""

import random

import pytest

from trackloom.llm import html_extraction as X

#: A heading and two paragraphs of one page each.
PAGES = {
    "English": ("The cost of buses", "The town has bought new buses for the two lines that run to the river, and the old ones will be sold at the end of the year. They had been in use for more than twenty years, which is a long time for a bus.", "Those who ride them to work say that they are quieter, but they also have to wait longer than before, as there are fewer of them. It is not known when more will come, and the town has said nothing about it."),
    "Italian": ("Il prezzo degli autobus", "Il comune ha comprato nuovi autobus per le due linee che arrivano al fiume, mentre quelli vecchi saranno venduti entro la fine dell'anno. Erano in servizio da oltre vent'anni, un tempo lungo per un mezzo così.", "Chi li prende ogni giorno dice che sono più silenziosi, ma bisogna aspettare più di prima perché sono di meno. Non si sa ancora quando ne arriveranno altri, e il comune finora non ha detto niente."),
    "Russian": ("Цена автобусов", "Город купил новые автобусы для двух линий, которые идут к реке, а старые будут проданы до конца года. Они служили больше двадцати лет, и для автобуса это очень долгий срок, говорят водители.", "Те, кто ездит на них каждый день, говорят, что они тише, но ждать приходится дольше, потому что их стало меньше. Когда придут другие, пока неизвестно, и город об этом ничего не сказал до сих пор."),
    "Greek": ("Η τιμή των λεωφορείων", "Ο δήμος αγόρασε καινούργια λεωφορεία για τις δύο γραμμές που φτάνουν στο ποτάμι, ενώ τα παλιά θα πουληθούν μέχρι το τέλος του χρόνου. Ήταν σε χρήση πάνω από είκοσι χρόνια, πολύς καιρός για λεωφορείο.", "Όσοι τα παίρνουν κάθε μέρα λένε ότι είναι πιο ήσυχα, αλλά περιμένουν περισσότερο από πριν, γιατί είναι λιγότερα. Δεν είναι γνωστό πότε θα έρθουν κι άλλα, και ο δήμος δεν έχει πει τίποτα."),
    "Polish": ("Cena autobusów", "Miasto kupiło nowe autobusy dla dwóch linii, które jadą nad rzekę, a stare zostaną sprzedane przed końcem roku. Jeździły ponad dwadzieścia lat, co dla autobusu jest bardzo długim czasem, mówią kierowcy.", "Ci, którzy jeżdżą nimi codziennie, mówią, że są cichsze, ale trzeba czekać dłużej niż dawniej, bo jest ich mniej. Nie wiadomo, kiedy przyjadą kolejne, a miasto dotąd nic o tym nie powiedziało."),
    "Turkish": ("Otobüslerin fiyatı", "Belediye, nehre giden iki hat için yeni otobüsler satın aldı, eskileri ise yıl sonuna kadar satılacak. Yirmi yıldan uzun süredir kullanılıyorlardı, bu bir otobüs için çok uzun bir zaman, diyor sürücüler.", "Her gün binenler, daha sessiz olduklarını, ama sayıları azaldığı için eskisinden daha uzun beklediklerini söylüyor. Yenilerinin ne zaman geleceği bilinmiyor, belediye bu konuda henüz bir şey söylemedi."),
    "Arabic": ("ثمن الحافلات", "اشترت المدينة حافلات جديدة للخطين اللذين يصلان إلى النهر، أما القديمة فستباع قبل نهاية العام. كانت تعمل منذ أكثر من عشرين عاما، وهذا وقت طويل جدا بالنسبة إلى حافلة، كما يقول السائقون هنا في المدينة.", "يقول الذين يركبونها كل يوم إنها أهدأ، لكنهم ينتظرون أكثر من قبل، لأن عددها أقل. لا أحد يعرف متى ستصل حافلات أخرى، ولم تقل المدينة شيئا عن ذلك حتى الآن، ولا عن ثمن التذاكر في العام القادم."),
    "Japanese": ("バスの値段", "町は川へ向かう二つの路線のために新しいバスを買い、古いバスは年末までに売られることになった。二十年以上も使われてきたので、バスとしてはとても長い間走ったことになると運転手たちは話している。", "毎日乗る人たちは、前より静かになったと言うが、台数が減ったので、待つ時間は長くなったそうだ。次のバスがいつ来るのかはまだ分からず、町もそれについては何も言っていないし、切符の値段も決まっていない。"),
    "Chinese": ("公共汽车的价格", "市里为通往河边的两条线路买了新的公共汽车，旧车将在年底以前卖掉。它们已经用了二十多年，司机们说，对一辆公共汽车来说，这是很长的时间了，有些座位也早就坏了，冬天车里非常冷。", "每天坐车的人说，新车比以前安静，可是因为车少了，等车的时间比从前更长。下一批车什么时候来，现在还不知道，市里到今天也没有说过什么，票价会不会涨，大家也都不清楚，只好等消息。"),
    "Thai": ("ราคารถเมล์", "เมืองได้ซื้อรถเมล์ใหม่สำหรับสองสายที่วิ่งไปถึงแม่น้ำ ส่วนรถเก่าจะถูกขายก่อนสิ้นปี รถเหล่านี้ใช้งานมานานกว่ายี่สิบปีแล้ว ซึ่งเป็นเวลาที่นานมากสำหรับรถเมล์คันหนึ่ง คนขับรถหลายคนบอกอย่างนั้น", "คนที่นั่งรถทุกวันบอกว่ารถเงียบกว่าเดิม แต่ต้องรอนานกว่าเมื่อก่อนเพราะมีรถน้อยลง ยังไม่มีใครรู้ว่ารถคันอื่นจะมาเมื่อไร และเมืองก็ยังไม่ได้พูดอะไรเกี่ยวกับเรื่องนี้เลยจนถึงวันนี้"),
}
SHELL = """<html><head><title>x</title></head><body><div class="menu"><a href="/">A</a> <a href="/b">B</a> <a href="/c">C</a></div>
<ul><li><a href="/1">{0}</a></li><li><a href="/2">{0}</a></li><li><a href="/3">{0}</a></li></ul>
<div{1}><h1>{0}</h1><p>{2}</p><p>{3}</p></div><div class="comments"><p>{3} {2}</p></div><footer><p>{2}</p></footer></body></html>"""


@pytest.mark.parametrize("language", PAGES)
def test_pages_keep_their_text_in_any_language(language):
    head, one, two = PAGES[language]
    page = SHELL.format(head, "", one, two)
    assert X.main_text(page) == "\n".join(PAGES[language])
    assert X.known_language(X.blocks(page), X.Rules()) == (language in ("English", "Italian") and X.stop_density(one + two) >= 0.12)


@pytest.mark.parametrize("attribute", [' title="The hidden cost of buses"', " title='style=display:none'", ' data-id="comment-7"', ' data-role="navigation"', ' title="a class=menu of role=search"', ' alt="aria-hidden=true"', ' data-hidden="x"'])
def test_attributes_that_only_look_like_marks(attribute):
    assert X.main_text(SHELL.format(PAGES["English"][0], attribute, *PAGES["English"][1:])) == "\n".join(PAGES["English"])


@pytest.mark.parametrize("attribute", [" hidden", ' hidden=""', ' style="color: red; display : none"', " aria-hidden=true", ' ARIA-HIDDEN="True"'])
def test_hidden_elements_are_no_text(attribute):
    page = SHELL.replace('<div class="comments"><p>{3} {2}</p></div>', "")
    assert X.main_text(page.format(PAGES["English"][0], attribute, *PAGES["English"][1:])) == "" and X.main_text(page.format(PAGES["English"][0], "", *PAGES["English"][1:]))


def plain_labels(found, rules):
    """Both passes by looking at all blocks again and again."""
    running = [b.text for b in found if not b.furniture and len(b.text) >= rules.short and b.linked <= rules.most_links * len(b.text)]
    known = not running or X.stop_density(" ".join(running)) >= rules.low_stops
    first = []
    for b in found:
        size = len(b.text) if known else X.extent(b.text)
        if b.furniture or b.linked / len(b.text) > rules.most_links or (not b.article and b.text.lower().startswith(("©", "copyright"))):
            first.append("bad")
        elif size < rules.short:
            first.append("bad" if b.linked and not b.article else "")
        else:
            good = X.stop_density(b.text) >= rules.high_stops if known else X.flows(b, rules)
            poor = known and X.stop_density(b.text) < rules.low_stops and not b.article
            enough = size >= (rules.long if known else rules.flowing) or b.article
            first.append(("good" if enough else "") if good else "bad" if poor else "")
    out = []
    for i, b in enumerate(found):
        before = [k for k in range(i) if first[k]][-1:]
        behind = [k for k in range(i + 1, len(found)) if first[k]][:1]
        near = [k for k in before + behind if found[k].article == b.article]
        runs = X.stop_density(b.text) >= rules.low_stops if known else X.flows(b, rules)
        if first[i]:
            out.append(first[i])
        elif b.article and not any(first[k] == "good" for k in near):
            out.append("good")
        elif any(x.article and not x.furniture for x in found) and not b.article:
            out.append("bad")
        elif not near:
            out.append("good" if runs and not any(first) else "bad")
        else:
            away = {k: sum(len(x.text) for x in found[min(i, k) + 1 : max(i, k)]) for k in near}
            nearest = min(near, key=lambda k: (away[k], first[k] == "bad"))
            out.append("good" if b.article else first[nearest])
    return out


def test_two_passes_against_plain_loops():
    draw, rules, seen = random.Random(1), X.Rules(), set()
    english = " ".join(PAGES["English"][1:]).split()
    for _ in range(400):
        other = draw.random() < 0.4
        source = " ".join(PAGES[draw.choice(["Russian", "Japanese", "Thai"])][1:]) if other else ""
        found = []
        for _ in range(draw.randrange(1, 14)):
            if other and draw.random() < 0.9:
                at = draw.randrange(60)
                text = source[at : at + draw.choice([8, 40, 90, 160, 300])]
            else:
                text = " ".join(draw.choice([english, ["xk", "rt", "qq"]])[: draw.choice([2, 9, 20, 38])])
            text = draw.choice(["", "", "", "© "]) + text
            found.append(X.Block(text=text, linked=draw.choice([0, 0, len(text) // 5, len(text)]), furniture=draw.random() < 0.1, article=draw.random() < 0.15))
        want = plain_labels(found, rules)
        X.judge(found, rules)
        assert [b.label for b in found] == want
        seen |= {*want}
    assert seen == {"good", "bad"}
