"""Words by which web pages label what is not their content. Fixed values, in six languages."""

from __future__ import annotations

import re

#: Entries of menus, sitemaps and footers.
LABELS = """
home; news; shop; help; contact; about us; about; search; sign in; log in; login; register; my account; account; basket;
cart; catalog; catalogue; products; topics; community; jobs; archive; downloads; download; store finder; sitemap;
imprint; privacy; privacy policy; terms of use; terms; accessibility; all rights reserved; legal notice; blog; faq; menu;
startseite; aktuelles; produkte; hilfe; kontakt; über uns; suche; anmelden; registrieren; warenkorb; themen; archiv;
filialen; impressum; datenschutz; agb; alle rechte vorbehalten; nutzungsbedingungen; barrierefreiheit; mein konto;
accueil; actualités; produits; aide; à propos; recherche; connexion; inscription; panier; rubriques; mentions légales;
vie privée; plan du site; tous droits réservés; confidentialité; boutique; mon compte;
inicio; noticias; productos; ayuda; contacto; quiénes somos; buscar; entrar; registrarse; cesta; temas; aviso legal;
privacidad; mapa web; todos los derechos reservados; tienda; mi cuenta; carrito;
главная; новости; каталог; помощь; контакты; о нас; поиск; войти; вход; регистрация; корзина; карта сайта;
все права защищены; условия использования; конфиденциальность; магазин; архив; темы;
首页; 新闻; 产品; 帮助; 联系; 联系我们; 关于我们; 搜索; 登录; 注册; 购物车; 专题; 下载; 网站地图; 使用条款; 隐私; 隐私政策;
保留所有权利; 商店; 社区; 归档
"""
#: Titles of side columns.
SIDE_TITLES = """
trending now; most read; recent posts; related; related articles; you may also like; more in this section; read next;
popular; latest; more stories; see also; ähnliche beiträge; auch interessant; meistgelesen; mehr zum thema; das könnte sie
auch interessieren; neueste beiträge; à lire aussi; sur le même sujet; les plus lus; articles similaires; voir aussi;
te puede interesar; lo más leído; artículos relacionados; más noticias; ver también; самое читаемое; похожие записи;
читайте также; популярное; ещё по теме; смотрите также; 猜你喜欢; 相关推荐; 热门文章; 相关阅读; 最新文章; 推荐阅读
"""
#: Whole lines that offer an action or stand for advertising; # is a number.
ACTIONS = """
advertisement; sponsored; ad; anzeige; werbung; publicité; publicidad; anuncio; реклама; 广告; 赞助;
back to top; skip to content; follow us; nach oben; zum inhalt; haut de page; aller au contenu; subir; volver arriba;
ir al contenido; наверх; к содержанию; 返回顶部; 跳到内容; 关注我们; suivez-nous; síguenos; folgen sie uns;
leave a comment; leave a comment (#); # comments; # people found this useful; # kommentare; kommentar schreiben;
# commentaires; laisser un commentaire; # comentarios; dejar un comentario; # комментариев; # комментария;
комментарии (#); комментариев: #; оставить комментарий; #条评论; 发表评论; comments (#); share; print; save;
send to a friend; share this page; teilen; seite drucken; drucken; partager; imprimer; compartir; imprimir; поделиться;
печать; 分享; 打印; 收藏; mail; copy link; email; tweet; subscribe to our newsletter and never miss a thing;
subscribe to our newsletter; newsletter; newsletter abonnieren; abonnez-vous à la lettre; recibe el boletín;
подписаться на рассылку; подпишитесь на рассылку; подписка на новости; 订阅邮件; 订阅
"""
#: Pieces of cookie and privacy notices; two of them, or one with a choice, make a notice.
NOTICE = """
cookie; privacy matters; stores small files; by staying here; speichert daten; garde des traceurs; guarda datos;
хранит настройки; 保存少量数据; similar tools; remember settings; measure visits; fitting offers; für einstellungen;
messung der besuche; mesurer l'audience; vos réglages; medir visitas; recordar ajustes; учёта посещений; 统计访问; 记住设置
"""
#: Choices such notices offer.
CHOICES = """
accept all; reject; settings; manage choices; ok; alle annehmen; ablehnen; mehr erfahren; tout accepter; refuser;
en savoir plus; aceptar todo; rechazar; más información; принять; отказаться; подробнее; 全部接受; 拒绝; 了解更多
"""
COPYRIGHT = re.compile(r"^\s*(?:©|\(c\)|copyright\b|urheberrecht\b|版权所有|авторские права)", re.I)


def _list(text: str) -> frozenset[str]:
    return frozenset(" ".join(x.split()).casefold() for x in text.split(";") if x.strip())


LABEL_SET, SIDE_SET, ACTION_SET, CHOICE_SET = map(_list, (LABELS, SIDE_TITLES, ACTIONS, CHOICES))
NOTICE_PIECES = tuple(sorted(_list(NOTICE)))
