"""The small labelled table of the body classifier: pages written for it, each line marked, in their own order.

`+` before a line: furniture (menu, notice, side column, share, comment, advertisement, footer); `.`: main body. The
first line of a page is its address. A page whose address ends in /caps is also read in capitals.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_PAGES = """
https://www.harborlight.test/a/caps
+Home | News | Shop | Contact | About us
+We use cookies to remember settings. Accept all | Reject | Settings
+Home > Harborlight > Boats
.The old ferry crosses the bay twice a day when the wind allows it. Crews repair the ramp every spring.
.Ropes and anchors
.Heavy ropes hold the barge against the northern pier, and the wardens count them at night.
.* Long anchor
.* Short chain for mooring
.A second crew paints the hull in June. It takes about 12 days.
+Leave a comment (12)
+Trending now
+Boat market in winter
+Lonely pier at dawn
+Harbor museum: 42
+© 2025 Harborlight Imprint Privacy

https://shop.milldale.example/item/4
+Basket (0)  Catalog  News  Community  Jobs  Store finder  About us
.Grain from the upper field is milled on Tuesdays, unless the river is low.
.Update 2
.The stone was replaced in 2019; since then flour is finer.
+Advertisement
.Bakers pick up sacks before noon. Late orders wait until Friday.
+Print | Save | Send to a friend
+You may also like
+Copper kettle
+Small oven beside the mill
+Copyright 2024-2025
+Milldale
+All rights reserved.
+Sitemap

https://lindenhof.test/blog/2/caps
+Suche | Kontakt | Hilfe | Aktuelles | Anmelden | Themen
+Wir verwenden Cookies zur Messung der Besuche. Mehr erfahren
+Hilfe > Lindenhof > Garten
.Der Hof liegt am Rand der Stadt und verkauft im Herbst Obst. Viele Gäste kommen mit dem Rad.
.Alte bäume
.Im Winter werden die Äste geschnitten, damit die Krone Licht bekommt.
.- Breite säge
.- Leiter aus holz
+Nach oben
.Die Ernte beginnt Ende August und dauert bis in den Oktober!
+123 Kommentare
+Ähnliche Beiträge
+Stille mühle am bach
+Markt: 2025-03-01
+Rote scheune
+Urheberrecht 2025
+Lindenhof
+Impressum
+Datenschutz

https://www.beaumont.example/p/9/caps
+Accueil » Actualités » Produits » Aide » Connexion
+Nous utilisons des cookies pour mesurer l'audience. Tout accepter | Refuser
+Aide » Beaumont » Rivière
.La rivière traverse le vallon et nourrit trois moulins. Les pêcheurs y viennent avant l'aube.
.Pont de pierre
.Le pont fut réparé deux fois; la seconde, en 1987, a duré un hiver.
+Publicité
.Un marché se tient chaque samedi près de l'écluse.
+45 commentaires
+Abonnez-vous à la lettre
+Partager | Imprimer
+Les plus lus
+Lanterne du port
+Vieille écluse
+Petit marché d'hiver
+Jardin clos: 7
+© 2025 Beaumont Tous droits réservés. Plan du site

https://molinoviejo.test/n/3
+Inicio » Entrar » Quiénes somos » Buscar
+Este sitio guarda datos para medir visitas. Aceptar todo | Rechazar
+Contacto > Molinoviejo > Huerta
.La huerta da tomates hasta octubre, y el riego llega por un canal antiguo.
.[42]
.Los vecinos limpian el canal en marzo. Cada familia pone una jornada.
.Puerta del norte
+Subir
.* Campana de bronce
.* Torre: 1850
.El reloj de la torre se paró hace años. Nadie lo echa de menos.
+Recibe el boletín
+Compartir | Imprimir
+Te puede interesar
+Feria de primavera
+Camino del puente
+© 2025 Molinoviejo Aviso legal Mapa web

https://rechka.example/z/1
+Главная | Новости | Каталог | О нас | Контакты | Войти
+Мы используем файлы cookie для учёта посещений. Принять | Отказаться
+Помощь > Rechka > Лодки
.Лодка стоит у причала с весны. Сторож проверяет её каждое утро.
.Старая пристань
.Рыбаки чинят сети, пока вода холодная.
+Реклама
.Вечером пристань пуста, и только фонарь горит над водой!
+Наверх
+Поделиться | Печать
+Самое читаемое
+Новая мельница
+Тихая улица: 12
+Рынок у моста
+© 2025 Rechka Все права защищены. Карта сайта

https://yunshan.test/d/7
+首页 | 新闻 | 产品 | 帮助 | 登录 | 购物车
+本站使用Cookie以记住设置。了解更多
+帮助 > Yunshan > 茶园
.茶园在山的南面，每年四月开始采摘。工人们清晨上山，中午回来。
.旧茶厂的仓库
.仓库建于1962年，后来改成了小博物馆！游客可以看到老式的机器。
+广告
.雨季的时候道路很滑，所以运输改在早上进行。
+12条评论
+返回顶部
+分享 | 打印 | 收藏
+相关推荐
+山下石桥的灯笼
+古镇的集市
+河边的水车
+版权所有 2025
+Yunshan
+保留所有权利
+网站地图

https://quietbay.example/x
.Corrected version
.Some mornings the bay is covered by fog, and the signal on the rock can be heard for miles.
.7870
.Nets dry on the wall. The children collect shells and sell them on Sunday.
.62.55
.Lighthouse keepers
.Three families kept the light in turn until 1974.

https://oldroad.test/y
+Skip to content
+More in this section
+Toll house
+Gravel road by the mill
+Milestone: 9
+(c) | Oldroad | All rights reserved. | Accessibility
+Store finder / Jobs / Downloads / Topics / Register
.The road was laid in stone by soldiers. Carts still use it in dry weather, unless the gate is shut.
.Milestones
.Every mile has a stone with a number, and some carry names.
+Follow us
.Riders change horses at the inn.
+Your privacy matters to us: to show fitting offers. By staying here you agree.

https://fensterbau.test/q
+Anzeige
.Ein Fenster aus Eiche hält lange. Man streicht es alle sechs Jahre.
+Seite drucken | Teilen
.Glas wird heute zweifach verwendet; früher war es einfach.
+Newsletter abonnieren
+Meistgelesen
+Tür aus glas
+Schmale treppe
+Werkstatt: 15.20
+Diese Seite speichert Daten für Einstellungen. Alle annehmen | Ablehnen
+(c)
+Fensterbau
+AGB

https://longfield.example/s
+Register · Contact · Sign in · Topics · News
+Cookies help us to remember settings. Manage choices
.Long fields need deep furrows, says the farmer, and the horses know it.
.Spare harness for two
.The harness hangs in the barn. It was mended 3 times.
.Barn door
.- Iron hinge: 12
.- Oak beam
.Rain falls in May; hay is late.
+35 people found this useful
+Subscribe to our newsletter and never miss a thing
+Share this page: mail, print, copy link
+Recent posts
+Gate by the river
+Well: 2024-01-02
+© 2025 | Longfield | Terms of use | Sitemap

https://nordwald.test/t
+Help
+Contact
+Basket (0)
+Shop
+Sign in
+News
+About us
+This site stores small files and similar tools - OK
+Help > Nordwald > Trees
.Cookies were baked for the visitors, and the privacy of the hut was respected by all.
.He opened the archive and read the news of the year before. Then he closed it and went home.
.A short note.
.The shop on the corner sells maps. Search parties use them.
+Back to top
+Related
+Deep snow
+Sledge with bells
+Forest path: 8
+Copyright 2024-2025 | Nordwald | Imprint | Sitemap

https://servicewelt.test/e
+Startseite » Hilfe » Kontakt
.Page not found
.Error 404
.Check the address or go back.
+Urheberrecht 2025 Servicewelt Alle Rechte vorbehalten. AGB

https://blankform.test/f
+Help · Community · Home · Jobs
.{{user_name}}
.price: {{item_price}}
.Text goes here.
.Please enable JavaScript and reload the page.
.Request id 1234
+© 2025 Blankform Terms of use Privacy

https://leichtbau.test/g
.Bitte aktivieren Sie JavaScript, um fortzufahren.
.Fehler 503
.Kennung 5512
+Impressum
+Datenschutz

https://xiaocheng.test/h
+联系
+新闻
+注册
+首页
+我们会保存少量数据用于统计访问。全部接受 | 拒绝
.错误404：页面不存在
.请稍后再试。
+版权所有 2025 Xiaocheng 保留所有权利 网站地图
.镇上的邮局下午关门。信件第二天送到，除了下雪的时候。
+猜你喜欢
+码头的钟楼
+冬天的渡船

https://lanterntown.test/a
.The lantern makers of the old town work in pairs. One bends the frame while the other cuts the glass, and by evening a dozen lamps hang in the window.
.Visitors come in autumn.
.How the glass is cut
.Each pane is scored twice with a small wheel; a third stroke would break it. Apprentices practise on bottles for a year.
.1. Mark the pane
.2. Score it
.3. Break it over the edge of the table
.Lamp oil is sold next door. It burns for nine hours.
.What the makers say about electric light has not changed in forty years, and visitors like to hear it told again.

https://bergbach.test/b
.Der Bach entspringt unter dem Gletscher und treibt im Tal zwei Sägen an. Im Frühjahr steigt er so hoch, dass die untere Brücke gesperrt wird.
.Hochwasser
.Im Jahr 1987 stand das Wasser bis an die Kirche. Seitdem gibt es einen Damm.
.Holz und Stein
.- Buche für die Griffe
.- Granit für die Mauer
.Heute wird nur noch eine der Sägen betrieben, und auch diese nur an zwei Tagen der Woche. Das Holz kommt aus dem Nachbartal!

https://valclair.example/c
.Le vallon reçoit peu de soleil en hiver, mais ses prés restent verts jusqu'en novembre.
.Les bergers montent en mai; ils redescendent à la Saint-Michel, avec les bêtes et le fromage de l'été.
.Fromage d'été
.Chaque meule pèse huit kilos. On la retourne tous les jours.
.Combien de temps dure l'affinage?

https://cerroazul.test/d
.El cerro se ve desde toda la comarca y en su cima hay una ermita del siglo doce.
.Camino de subida
.El sendero sale de la plaza y tarda dos horas. Conviene llevar agua, sombrero y algo de abrigo para el viento de la tarde.
.Los pastores lo usan todo el año.

https://tikhaya.example/e
.Река замерзает в декабре, и до марта по льду ходят почтовые сани. Летом вместо них плывёт баржа.
.Зимняя дорога
.Дорогу отмечают ёлками через каждые сто шагов. После метели их ставят заново, и так всю зиму.
.Весной лёд уходит за одну ночь!

https://qingshi.test/f
.青石镇有三座桥，最老的一座建于明代。每天早上，卖菜的农民都要从桥上走过。
.桥上的石狮
.石狮一共十二只，其中两只在洪水中丢失，后来由镇上的石匠重新雕刻。
.雨天桥面很滑，孩子们要绕路上学。

https://formwerk.test/g
.{{user_name}}
.Price: {{item_price}}
.Title: {{item_title}}
.{{city}} / {{street}}
.{{post_date}}

https://formwerk.test/h
+Help · Community · Home · Jobs · Search
.committee: {{user_link}}
.{{author_city}}
.Überschrift: ${title}
.[insert summary]
.Hello __FIRST_NAME__, your order %ORDER_ID% is ready.
+Back to top
+Trending now
+Old toll house
+Wet stones: 41
+Winter fair
+© 2024 Formwerk Imprint Privacy

https://statusseite.test/i
.503
.Service unavailable
.Please try again later
.Request id 88412

https://statusseite.test/j
+Startseite | Suche | Themen
.Fehler 404
.Die Seite wurde nicht gefunden
.Zurück zur Startseite
+Impressum
+Datenschutz

https://mulinodelponte.test/k
+Chi siamo | Prodotti | Lavora con noi | Stampa | Dove siamo
.Il mulino macina ancora il grano della valle, e chi vuole può portare il proprio sacco il sabato mattina.
.La ruota
.La ruota fu rifatta in larice nel 1994. Gira piano quando il fiume è basso.
+Stampa | Condividi | Salva
.D'inverno il mugnaio lavora da solo. In estate lo aiutano i nipoti.
+Contatti | Note legali | Mappa

https://windvaan.test/l
+Over ons · Winkel · Nieuwsbrief · Vacatures · Contact opnemen
+Start > Gereedschap > Zagen
.De molen op de dijk zaagt eiken voor de scheepsbouw, maar alleen wanneer de wind uit het westen komt.
.Onderhoud
.Elk jaar worden de wieken geschilderd. Dat duurt ongeveer een week.
.- Lijnolie
.- Rode menie
.Bezoekers mogen naar boven, mits het droog is.
+Algemene voorwaarden | Cookiebeleid | Retourneren

https://marealta.example/m
+Notícias » Loja » Quem somos » Fale conosco
.A maré sobe duas vezes por dia e leva as redes para dentro da baía. Os pescadores esperam no cais.
.Barcos de madeira
.São feitos de pinho e pintados de azul. Um barco dura trinta anos, se for bem cuidado.
.O mercado abre às cinco.
+Imprimir | Enviar | Guardar

https://stonebridge.test/n
+Pricing | Careers | Press | Investors | Developers | Status
+Docs / Guides / Reference
.The bridge carries carts and cattle, never both at once. A keeper on each bank rings a bell before the gate is raised.
.Tolls
.A cart pays two pence, a rider one. Children cross free on market days, unless they push a barrow.
.The keeper writes every crossing in a book
.Keepers are chosen by lot. They serve one winter.
+Log out | Preferences | Notifications

https://kettlework.test/o
+Home | News | Shop | Contact | About us
.Copper kettle, second size
.Weight: 3.2 kg
.Height: 41 cm
.Spout: brass, 12
.The kettle is hammered from one sheet and tinned inside. It holds four litres and stands on three short legs.
+Advertisement
.Care: wipe it dry
.Never leave water in it overnight. Vinegar and salt take the stains away.
.Lid
.Handle: beech 4
+Cookies help us to remember settings. Manage choices
.The lid is cast, not hammered, and fits every kettle of this size.
+Leave a comment (4)
.Repairs: workshop 12
.Bring the kettle on a Monday
+© 2025 Kettlework Imprint Privacy

https://kettlework.test/p
+Community
.2024-03-09
.Steady hands make a round bowl, says the smith, and turns the sheet once more before the next blow.
.Second bowl
.First heat: 640
.Second heat: 590
.Third heat: 540
+Print | Save | Send to a friend
.Third bowl
.It took a morning to raise the wall and an hour to planish it!
.Bowls in stock: 7
.Last fair
.Notes: see 1987

https://werkhalle.test/q
+Suche | Kontakt | Hilfe | Aktuelles | Anmelden | Themen
.Platzhalter Überschrift
.Blindtext für das Layout 3
.Hier steht später Text
+© 2025 Werkhalle Impressum Datenschutz

https://werkhalle.test/r
.Zange: 14.6
.Breite: 120
.Schmale Leiste mit Nut
.Leim
.Die Leiste wird in die Nut geschoben und über Nacht gepresst. Am Morgen ist sie fest.
+Anzeige
.Presse: 2 Spindeln
.Zwischen den Backen liegt ein Brett, damit das Holz keine Druckstellen bekommt.
+Kommentar schreiben
.Säge 1850
+12 Kommentare
.Hobel: eisen 45
.Ein guter Hobel kostet mehr als die Bank, auf der er liegt; dafür hält er ein Leben lang.
.Maße: 22 x 8
.Gewicht: 2.1

https://werkhalle.test/s
.лампа: {{city}}
.тарелка: [[author]]
.стол: [[site]]
.码头: [insert phone here]
.抓取器: [insert region here]
.quelle: %ORDER_IMAGE%
.bücherei: %SHOP_NAME%

https://salteria.test/t
+Accueil » Actualités » Produits » Aide » Connexion
.Sel: gros 25
.Sel fin
.Récolte: août
.Le sel est ramassé à la main sur six bassins et sèche deux semaines au vent du large.
+Publicité
.Prix du sac
.Sac: 12.50
.Les sacs partent le jeudi. Le reste attend la semaine suivante, avec les commandes des épiceries.
+45 commentaires
.Bassin: nord 3
.Tarif d'hiver
+© 2025 Salteria Plan du site

https://yunhe.test/u
+首页 | 新闻 | 产品 | 帮助 | 登录
.运河: 第二段
.长度: 42
.船闸
.运河的第二段修于清代，至今还有货船经过，每天上午开闸一次。
+广告
.船闸: 三号
.闸门很重，要四个人才能推开。冬天闸门会结冰，需要用热水浇开。
+12条评论
.水位: 2.4
.下一站
+版权所有 2025 Yunhe

https://plaza.test/v
+Inicio » Entrar » Buscar
.Farol: hierro 9
.Banco de piedra
.Fuente: 1850
.La fuente del centro se llena desde el cerro y nunca se ha secado, ni en los veranos más largos.
+Publicidad
.Árbol viejo
.El árbol fue plantado por un alcalde cuyo nombre nadie recuerda. Da sombra a media plaza.
+3 comentarios
.Horario: 9-14
+© 2025 Plaza Aviso legal

https://bereg.example/w
+Главная | Новости | Контакты
.Лодка: 4 места
.Весло
.Длина: 3.2
.Лодку смолят весной, и к маю она уже на воде. Вёсла лежат в сарае, рядом с сетями.
+Реклама
.Якорь: железо 12
.Якорь бросают с кормы. На быстрине нужен второй, и оба держат плохо.
+4 комментария
.Сети: новые
+© 2025 Bereg Все права защищены
"""


#: Versions of each page with some lines left out; what stays keeps its order, so neighbours are those of real pages.
VERSIONS, LEFT_OUT = 12, 0.2


def pages(text: str = _PAGES, versions: int = VERSIONS) -> Iterator[tuple[str, list[str], list[int]]]:
    """(address, lines, marks: 1 furniture): each page as written, then with lines left out."""
    rnd = random.Random(7)
    for block in text.strip().split("\n\n"):
        url, *rows = block.split("\n")
        for k in range(versions + 1):
            kept = [r for r in rows if not k or rnd.random() >= LEFT_OUT]
            lines, marks = [r[1:] for r in kept], [int(r[0] == "+") for r in kept]
            if not lines:
                continue
            yield url, lines, marks
            if url.endswith("/caps"):
                yield url, [x.upper() for x in lines], marks
